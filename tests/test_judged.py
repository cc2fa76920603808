"""Repeated stratified folds, forests out of fold, and scenes replaced on a stream."""

from collections import Counter, defaultdict

import pytest
from geolattice.operators.forest import fold_quality, out_of_fold, stratified_folds
from geolattice.session import saved
from geolattice.sources.catalog import newest_per_tile
from geolattice.streaming.replacement import replaced_scenes
from pyspark.sql import functions as F


def rows(spark, n=240):
    """A label that two of three features decide, but for a few rows, and a rule that sees one."""
    data = [(i, int((i * 37 % 100 > 60) ^ (i % 29 == 0)), float(i * 37 % 100), float(i * 53 % 17), float(i % 3), int(i * 37 % 100 > 90), "x") for i in range(n)]
    return spark.createDataFrame([*data, (n, None, 1.0, 1.0, 1.0, 0, "x")], "id long, label int, a double, b double, c double, rule int, repeat_ string")


def test_folds_are_even_in_each_class_and_the_same_under_any_partitioning(spark):
    one = stratified_folds(rows(spark), key="id", label="label", repeats=4).collect()
    again = stratified_folds(rows(spark).repartition(13), key="id", label="label", repeats=4).collect()
    assert sorted(map(str, one)) == sorted(map(str, again)) and len(one) == 4 * 240
    sizes = defaultdict(Counter)
    for r in one:
        sizes[r.repeat, r.label][r.fold] += 1
    assert all(len(c) == 5 and max(c.values()) - min(c.values()) <= 1 for c in sizes.values())
    by = {(r.repeat, r.id): r.fold for r in one}
    assert any(by[1, i] != by[2, i] for i in range(240))
    assert stratified_folds(rows(spark).limit(0), key="id", label="label").isEmpty()


def test_each_row_is_scored_once_a_repeat_and_alike_in_every_run(spark):
    kwargs = dict(key="id", label="label", features=["a", "b", "c"], splits=3, repeats=2, trees=10, depth=4)
    one = saved(out_of_fold(rows(spark), saved, **kwargs), "t")
    again = out_of_fold(rows(spark).repartition(9), saved, **kwargs)
    assert sorted(map(str, one.collect())) == sorted(map(str, again.collect()))
    assert Counter((r.repeat, r.id) for r in one.collect()) == Counter((k, i) for k in (1, 2) for i in range(240))
    guess = one.withColumn("guess", (F.col("score") >= 0.5).cast("int"))
    got = {(r.repeat, r.fold): r for r in fold_quality(guess, label="label", guess="guess").collect()}
    for key, r in got.items():
        own = [(x.label, x.guess) for x in guess.collect() if (x.repeat, x.fold) == key]
        tp, fp, fn, tn = (own.count(c) for c in ((1, 1), (0, 1), (1, 0), (0, 0)))
        assert r.balanced_accuracy == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2) and r.precision == pytest.approx(tp / (tp + fp)) and r.recall == pytest.approx(tp / (tp + fn))
    rule = {(r.repeat, r.fold): r.balanced_accuracy for r in fold_quality(one, label="label", guess="rule").collect()}
    assert all(got[k].balanced_accuracy > rule[k] for k in got)


def test_one_class_and_no_rows(spark):
    kwargs = dict(key="id", label="label", features=["a"], splits=2, repeats=1, trees=2)
    assert {r.score for r in out_of_fold(rows(spark).filter("label = 1"), saved, **kwargs).collect()} == {1.0}
    assert out_of_fold(rows(spark).limit(0), saved, **kwargs).isEmpty()


def test_a_stream_chooses_the_scenes_that_a_batch_does(spark, tmp_path):
    batches = [
        [("2024-01-03", "T1", "a", "04.00", "https://x"), ("2024-01-03", "T2", "b", None, "https://x"), (None, "T1", "n", "09.00", "https://x")],
        [("2024-01-03", "T1", "c", "05.00", "https://x"), ("2024-01-03", "T1", "d", "05.00", "https://x"), ("2024-01-20", "T1", "e", "05.00", "https://x"), ("2024-01-03", "T2", "f", "02.00", "https://x")],
        [("2024-01-03", "T1", "g", "03.00", "https://x"), ("2024-01-04", "T1", "h", "05.00", "https://x"), ("2024-01-20", "T1", "e", "05.00", "https://x")],
        [("2024-03-20", "T1", "i", "05.00", "https://x")],
        [("2024-03-20", "T1", "j", "05.10", "https://x")],
        [("2024-01-03", "T1", "z", "99.00", "https://x")],
    ]
    schema = "day string, tile string, id string, baseline string, href string"
    for k, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).selectExpr("to_date(day) as day", "tile", "id", "baseline", "href").coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    given = spark.read.parquet(f"{tmp_path}/in")
    flat = spark.createDataFrame([], schema).selectExpr("to_date(day) as day", "tile", "id", "baseline", "href").schema
    seen: dict = {}

    def take(batch, number):
        for r in batch.collect():
            seen[r.day, r.tile] = (r.id, r.baseline)

    for k in range(len(batches)):
        stream = spark.readStream.schema(flat).parquet(f"{tmp_path}/in/b=[0-{k}]")
        q = replaced_scenes(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    asset = F.create_map(F.lit("red"), F.struct("href"))
    want = newest_per_tile(given.filter("b < 5 and day is not null").drop("b").withColumn("assets", asset), ["red"]).collect()
    # the last scene comes for a day that is closed, so the stream leaves it out
    assert seen == {(r.day, r.tile): (r.id, r.baseline) for r in want}
    assert seen[want[0].day.replace(month=1, day=3), "T1"] == ("d", "05.00")
