"""The batch definitions on streams: local-day windows with a watermark, and months kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from geolattice.operators.dates import ZONE


def daily(events: DataFrame, *, ts: str = "ts", value: str = "value", keys: tuple[str, ...] = ("event_type",), zone: str = ZONE, late: str | None = None) -> DataFrame:
    """(day, keys, n, total, mean) by local day; on a stream, rows later than ``late`` are left out and days close behind the watermark."""
    rows = events.withColumn("__at", F.from_utc_timestamp(ts, zone))
    if late and events.isStreaming:
        rows = rows.withWatermark("__at", late)
    done = rows.groupBy(F.window("__at", "1 day").alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return done.select(F.to_date("w.start").alias("day"), *keys, "n", "total", "mean")


def keep_months(days: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds what a stream of (day, ...) rows brings to a table by month; ``kept_months`` reads it.

    The latest month seen by earlier batches is open: its rows may come in several batches. Earlier months are closed and never
    change again, so rows that come later for one are left out; a month between two others that brought nothing is closed too, and is kept as a
    row without a day. A batch writes partitions of its own, so that a replay writes the same ones again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("month", F.date_format("day", "yyyy-MM"))
        before = stored(spark, path, rows.schema)
        last = before.filter(F.col("batch") < number).agg(F.max("month")).first()[0] if before is not None else None
        rows = rows.filter(F.col("month").isNotNull())
        if last:
            rows = rows.filter(F.col("month") >= last)
        rows = rows.persist()
        first, newest = rows.agg(F.min("month"), F.max("month")).first()
        if newest:
            span = F.sequence(*[F.to_date(F.lit((x or first) + "-01")) for x in (last, newest)], F.expr("interval 1 month"))
            empty = spark.range(1).select(F.explode(span).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month")).filter(F.col("month") != F.lit(last or ""))
            empty = empty.join(rows.select("month").distinct(), "month", "left_anti")
            rows.unionByName(empty, allowMissingColumns=True).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(path)
        rows.unpersist()

    return days.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table of ``keep_months`` with its batches; None where nothing is written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    names = [f for f in schema.fields if f.name != "month"]
    return spark.read.schema(StructType([*names, StructField("month", StringType()), StructField("batch", LongType())])).parquet(path)


def kept_months(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the table that ``keep_months`` writes from rows of ``schema``, with their month."""
    found = stored(spark, path, schema)
    if found is None:
        return spark.createDataFrame([], StructType([*schema.fields, StructField("month", StringType())]))
    return found.drop("batch")
