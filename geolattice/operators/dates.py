"""Choosing dates: days of scenes, samples, base dates, pairs and what stands out for its month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ZONE = "America/Mexico_City"


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def by_day(scenes: DataFrame, zone: str = ZONE) -> DataFrame:
    """(day, scenes, cloud): the scenes of a local day and their mean cloud, unknown ones aside."""
    return scenes.groupBy(local_day(F.col("ts"), zone).alias("day")).agg(F.count("*").alias("scenes"), F.avg("cloud").alias("cloud"))


def even_sample(days: DataFrame, n: int, day: str = "day") -> DataFrame:
    """At most n days, evenly spaced in order: places round(i * (count - 1) / (n - 1)); one day alone is the first."""
    ranked = days.select(day).distinct().withColumns({"__k": F.row_number().over(Window.orderBy(day)) - 1, "__n": F.count("*").over(Window.partitionBy())})
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("__n") - 1) / F.lit(max(n - 1, 1)) + 0.5))
    return ranked.filter((F.col("__n") <= n) | F.array_contains(places, F.col("__k"))).drop("__k", "__n")


def base_date(days: DataFrame, end: Column, gap: int = 30, within: int = 12, fallback: tuple[int, int] = (14, 75), *, keys: list[str] | None = None) -> DataFrame:
    """For each key the day nearest to ``gap`` days before ``end``: one within ``within`` days of it, else one in the fallback range. tier says which."""
    keys = keys or []
    back = F.datediff(end, F.col("day"))
    off = F.abs(back - gap)
    tier = F.when(off <= within, 1).when(back.between(*fallback), 2)
    ranked = days.withColumns({"tier": tier, "__off": off}).filter("tier is not null")
    return ranked.groupBy(*keys).agg(F.min_by(F.struct("day", "tier"), F.struct("tier", "__off", F.datediff(end, F.col("day")))).alias("x")).select(*keys, "x.*")


def consecutive(granules: DataFrame, stack: list[str], ts: str) -> DataFrame:
    """Pairs of neighbours in time within a stack, with days between and a grade: good to 12, acceptable to 48, else doubtful."""
    w = Window.partitionBy(*stack).orderBy(ts)
    pairs = granules.select(*stack, ts).distinct().withColumn("second", F.lead(ts).over(w)).filter("second is not null")
    days = F.datediff("second", ts)
    return pairs.select(*stack, F.col(ts).alias("first"), "second", days.alias("days"), F.when(days <= 12, "good").when(days <= 48, "acceptable").otherwise("doubtful").alias("grade"))


def seasonal_outliers(series: DataFrame, value: str, cut: float, day: str = "day") -> DataFrame:
    """Adds the median of the same month in any year, and whether the value is further from it than ``cut``."""
    w = Window.partitionBy(F.month(day))
    return series.withColumn("month_median", F.median(value).over(w)).withColumn("outlier", F.abs(F.col(value) - F.col("month_median")) > cut)


def best_of_month(scenes: DataFrame, limit: float = 10.0) -> DataFrame:
    """For each month the day with the least cloud, newest of equals, if that is at most ``limit``; else null."""
    best = scenes.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.min_by(F.struct("day", "cloud"), F.struct(F.col("cloud"), -F.unix_date("day"))).alias("x"))
    return best.select("month", F.when(F.col("x.cloud") <= limit, F.col("x.day")).alias("day"), F.when(F.col("x.cloud") <= limit, F.col("x.cloud")).alias("cloud"))


def months_between_inclusive(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value: str, days: int = 32) -> DataFrame:
    """Left rows with the latest ``value`` of the right at or before theirs, or null: no pairs are made.

    Time (dates or timestamps) is cut into stretches of ``days``; a window orders one stretch of a key, and the last value of the stretches
    before comes from a running look over one row a stretch.
    """
    at = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    side = right.filter(F.col(value).isNotNull()).select(*keys, F.col(right_at).alias("__at"), F.col(value).alias("__v"), F.lit(0).alias("__left"), *[F.lit(None).cast(t).alias(f"__{c}") for c, t in left.dtypes if c not in keys])
    main = left.select(*keys, F.col(left_at).alias("__at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__left"), *[F.col(c).alias(f"__{c}") for c in left.columns if c not in keys])
    rows = side.unionByName(main).withColumn("__stretch", at(F.col("__at")))
    before = Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "__stretch").agg(F.max_by("__v", F.when(F.col("__left") == 0, F.col("__at"))).alias("__end"))
    carried = ends.select(*keys, "__stretch", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    w = Window.partitionBy(*keys, "__stretch").orderBy("__at", "__left").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__left = 1").join(carried, [*keys, "__stretch"])
    return found.select(*[F.col(c) if c in keys else F.col(f"__{c}").alias(c) for c in left.columns], F.coalesce("__v", "__carried").alias(value))
