"""Order statistics by rank, which Spark's percentile functions don't offer; no global order is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that a key's rows are cut into.
RANGES = 64


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, below) of each different non-null value of a key: its rows, and the rows of the key with a smaller value.

    Equal values are counted first. A key's values are then cut into RANGES ranges at approximate quantiles and summed within ranges, so
    that no task orders all values of a key; which cuts are chosen changes nothing in the result. Values are numbers or dates.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 1000).alias("__cuts"))
    cut = counts.join(cuts, keys) if keys else counts.join(F.broadcast(cuts))
    cut = cut.withColumn("__range", F.size(F.filter("__cuts", lambda x: x < F.col(value)))).drop("__cuts")
    totals = cut.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("__below", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return summed.join(totals, [*keys, "__range"]).select(*keys, value, "n", (F.col("__before") + F.col("__below")).alias("below"))


def rank_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the value at rank min(n - 1, floor(share * n)) of its non-null values in order, by name of ``shares``."""
    ranked = ranked_values(df, keys, value)
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__all"))
    ranked = ranked.join(sizes, keys) if keys else ranked.join(F.broadcast(sizes))
    at = lambda share: F.least(F.col("__all") - 1, F.floor(F.lit(share) * F.col("__all")))
    picked = lambda share: F.min(F.when(F.col("below") + F.col("n") > at(share), F.col(value)))
    return ranked.groupBy(*keys).agg(*[picked(s).alias(n) for n, s in shares.items()])


def with_average_rank(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Adds the rank from 1 in which ties share the mean of their places; null values have none."""
    keys = keys or []
    ranked = ranked_values(df, keys, value).select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2.0).alias(name))
    return df.join(ranked, [*keys, value], "left")


def average_rank(order: Column, *keys: str) -> Column:
    """Rank from 1 within keys, in which ties share the mean of their places: a window for keys of bounded size."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(order)) + (F.count("*").over(Window.partitionBy(*keys, order)) - 1) / 2.0


def terciles(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Adds tercile 1 to 3, cut at the linear 1/3 and 2/3 quantiles, each cut in the class below."""
    keys = keys or []
    edges = df.groupBy(*keys).agg(*[F.expr(f"percentile({value}, {k}D / 3)").alias(f"__e{k}") for k in (1, 2)])
    joined = df.join(edges, keys) if keys else df.join(F.broadcast(edges))
    tercile = F.when(F.col(value) <= F.col("__e1"), 1).when(F.col(value) <= F.col("__e2"), 2).when(F.col(value).isNotNull(), 3)
    return joined.withColumn("tercile", tercile.cast("long")).drop("__e1", "__e2")


def spearman(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Rank correlation of two columns for each key; rows with a null in either are left out."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.withColumns({"__a": average_rank(F.col(a), *keys), "__b": average_rank(F.col(b), *keys)})
    return ranked.groupBy(*keys).agg(F.corr("__a", "__b").alias("rho"), F.count("*").alias("n"))
