"""A random forest judged by repeated stratified folds against a rule."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a row's key by which a stratum is dealt into parts that are ranked on their own.
DIGITS = 3


def stratified_folds(rows: DataFrame, *, key: str, label: str, splits: int = 5, repeats: int = 20, seed: int = 7) -> DataFrame:
    """``rows`` once for each repeat, with repeat (from 1) and fold (from 0): the folds of a stratum differ by one row at most.

    A row's place in its stratum is its rank by a hash of (seed, repeat, key), so the folds are the same in every run and under any
    partitioning. Ranks are taken within parts of a stratum, to which the rows of the parts in front are added, so that no stratum is
    sorted in one task. Rows without a label are left out; rows alike in key and label share their hash and follow each other.
    """
    each = rows.filter(F.col(label).isNotNull()).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    each = each.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("repeat").cast("string"), F.col(key).cast("string")).cast("binary")))
    each = each.withColumn("__part", F.substring("__hash", 1, DIGITS))
    part = ["repeat", label, "__part"]
    front = Window.partitionBy("repeat", label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = each.groupBy(*part).agg(F.count("*").alias("__n")).withColumn("__front", F.coalesce(F.sum("__n").over(front), F.lit(0))).drop("__n")
    ranked = each.withColumn("__rank", F.row_number().over(Window.partitionBy(*part).orderBy("__hash", key))).join(sizes, part)
    return ranked.withColumn("fold", ((F.col("__front") + F.col("__rank") - 1) % splits).cast("int")).drop("__hash", "__part", "__rank", "__front")


def out_of_fold(
    rows: DataFrame, save: Callable[[DataFrame, str], DataFrame], *, key: str, label: str, features: list[str], splits: int = 5, repeats: int = 20, trees: int = 500, depth: int = 8, seed: int = 7
) -> DataFrame:
    """(key, label, other columns, repeat, fold, score): each labelled row scored once in each repeat, by a forest that never saw it.

    ``label`` is 0 or 1. Classes weigh alike in each fit, leaves hold two rows or more. Rows are dealt and ordered by their key before
    a fit, which makes its bootstrap samples the same in every run. A fold's fit is one Spark job after the other, so the number
    of jobs is splits times repeats, whatever the rows; what comes to the driver are the counts of classes of each fold.
    A fold whose training rows are of one class scores its rows with that class.
    """
    dealt = save(VectorAssembler(inputCols=features, outputCol="__features").transform(stratified_folds(rows, key=key, label=label, splits=splits, repeats=repeats, seed=seed)), "folds")
    counts = {(r["repeat"], r["fold"], r[label]): r["n"] for r in dealt.groupBy("repeat", "fold", label).agg(F.count("*").alias("n")).collect()}
    scored = []
    for repeat, fold in sorted({k[:2] for k in counts}):
        own = {c: sum(n for (r, f, y), n in counts.items() if (r, y) == (repeat, c) and f != fold) for c in (0, 1)}
        test = dealt.filter((F.col("repeat") == repeat) & (F.col("fold") == fold))
        if not all(own.values()):
            scored.append(test.drop("__features").withColumn("score", F.lit(float(own[1] > 0))))
            continue
        weight = F.when(F.col(label) == 1, sum(own.values()) / (2.0 * own[1])).otherwise(sum(own.values()) / (2.0 * own[0]))
        train = dealt.filter((F.col("repeat") == repeat) & (F.col("fold") != fold)).select(F.col(key), F.col(label).cast("double").alias("__label"), weight.alias("__weight"), "__features")
        train = train.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
        model = RandomForestClassifier(
            featuresCol="__features", labelCol="__label", weightCol="__weight", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__guess", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed * 1000 + repeat
        ).fit(train)
        scored.append(model.transform(test).withColumn("score", F.round(vector_to_array("__p")[1], 9)).drop("__p", "__raw", "__guess", "__features"))
    if not scored:
        return dealt.drop("__features").withColumn("score", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, scored)


def fold_quality(scored: DataFrame, *, label: str, guess: str) -> DataFrame:
    """(repeat, fold, n, balanced_accuracy, precision, recall) of a column of guesses; a precision of no guess is 0, and accuracy is over the classes that a fold has."""
    count = lambda y, g: F.count(F.when((F.col(label) == y) & (F.col(guess) == g), 1))
    cells = scored.groupBy("repeat", "fold").agg(F.count("*").alias("n"), count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn"), count(0, 0).alias("tn"))
    of = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    yes, no = of("tp", "fn"), of("tn", "fp")
    accuracy = (F.coalesce(yes, F.lit(0.0)) + F.coalesce(no, F.lit(0.0))) / (yes.isNotNull().cast("int") + no.isNotNull().cast("int"))
    return cells.select("repeat", "fold", "n", accuracy.alias("balanced_accuracy"), F.coalesce(of("tp", "fp"), F.lit(0.0)).alias("precision"), F.coalesce(yes, F.lit(0.0)).alias("recall"))
