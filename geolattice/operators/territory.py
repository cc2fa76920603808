"""Statistics of territorial units: cohorts, stocks, shares, ranks, areal splits and access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.functions.order_stats import ranked_values


def cohort_curve(events: DataFrame, unit: str, month: str, n: str, capacity: str) -> DataFrame:
    """Cumulative share of a unit's capacity by month of age, capped at 1, on a spine without gaps. Age 0 is the first month."""
    monthly = events.groupBy(unit, F.trunc(month, "month").alias("m")).agg(F.sum(n).alias("n"), F.max(capacity).alias("cap"))
    spine = monthly.groupBy(unit).agg(F.min("m").alias("a"), F.max("m").alias("b"), F.max("cap").alias("cap")).select(unit, "cap", "a", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    w = Window.partitionBy(unit).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    filled = spine.join(monthly.select(unit, "m", "n"), [unit, "m"], "left")
    total = F.sum(F.coalesce("n", F.lit(0))).over(w)
    return filled.select(unit, F.months_between("m", "a").cast("long").alias("age"), F.least(total / F.col("cap"), F.lit(1.0)).alias("share"))


def stock_before(flows: DataFrame, keys: list[str], at: str, n: str, stock: Column) -> DataFrame:
    """The stock at the end of each period, given the final one: what later periods added is taken off."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    return flows.withColumn("stock", stock - F.coalesce(F.sum(n).over(w), F.lit(0)))


def contribution(parts: DataFrame, unit: str, period: str, n: str) -> DataFrame:
    """Mean over periods of a unit's share of the period's total."""
    whole = F.sum(n).over(Window.partitionBy(period))
    return parts.groupBy(unit, period).agg(F.sum(n).alias(n)).withColumn("__s", F.col(n) / whole).groupBy(unit).agg(F.avg("__s").alias("share"), F.count("*").alias("periods"))


def votes(scores: DataFrame, unit: str, scenarios: list[str], top: int) -> DataFrame:
    """How often a unit is among the ``top`` of a scenario (rank by falling value, ties share the best), and its best rank."""
    long_ = scores.select(unit, F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(s).cast("double").alias("v")) for s in scenarios])).alias("x")).select(unit, "x.*")
    long_ = long_.withColumn("v", -F.col("v"))
    places = ranked_values(long_, ["scenario"], "v").select("scenario", "v", (F.col("below") + 1).alias("rank"))
    ranked = long_.join(places, ["scenario", "v"])
    return ranked.groupBy(unit).agg(F.sum((F.col("rank") <= top).cast("long")).alias("votes"), F.min("rank").cast("long").alias("best"))


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def areal_split(values: DataFrame, overlaps: DataFrame, unit: str, zone: str, value: str, outside: str) -> DataFrame:
    """A unit's value spread over zones by share of its area (overlaps: unit, zone, share); what falls in none goes to ``outside``."""
    spread = values.join(overlaps, unit).groupBy(zone).agg(F.sum(F.col(value) * F.col("share")).alias(value))
    given = values.agg(F.sum(value).alias("__all")).join(spread.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("__in")))
    return spread.unionByName(given.select(F.lit(outside).alias(zone), (F.col("__all") - F.col("__in")).alias(value)))


def access_curve(people: DataFrame, distance: str, weight: str, cuts: list[int]) -> DataFrame:
    """(cut, share) of the weight within each distance, in one pass over the rows."""
    total = F.sum(weight)
    sums = people.agg(*[(F.sum(F.when(F.col(distance) <= c, F.col(weight)).otherwise(0)) / total).alias(f"s{c}") for c in cuts])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("cut"), F.col(f"s{c}").alias("share")) for c in cuts])).alias("x")).select("x.*")


def meets_any(pairs: DataFrame, origin: str, rules: list[tuple[float, float]], size: str = "ha", distance: str = "d") -> DataFrame:
    """Whether an origin has some place of at least a size within a distance, by any of the (size, distance) rules."""
    ok = reduce(lambda a, b: a | b, [(F.col(size) >= s) & (F.col(distance) <= d) for s, d in rules])
    return pairs.groupBy(origin).agg(F.bool_or(ok).alias("meets"))


def nearest(points: DataFrame, places: DataFrame, cell: float, reach: int = 1) -> DataFrame:
    """(id, place, d): the nearest place (place, px, py) within ``cell`` * ``reach`` of each point (id, x, y), least id of equals.

    Points meet the places of their own and the adjacent cells only.
    """
    cut = lambda v: F.floor(v / cell)
    around = F.sequence(F.lit(-reach), F.lit(reach))
    spread = places.withColumn("__i", F.explode(F.transform(around, lambda k: cut(F.col("px")) + k))).withColumn("__j", F.explode(F.transform(around, lambda k: cut(F.col("py")) + k)))
    met = points.withColumns({"__i": cut(F.col("x")), "__j": cut(F.col("y"))}).join(spread, ["__i", "__j"])
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    return met.withColumn("d", d).filter(F.col("d") <= cell * reach).groupBy("id").agg(F.min_by(F.struct("place", "d"), F.struct("d", "place")).alias("n")).select("id", "n.*")


def running_total(flows: DataFrame, keys: list[str], at: str, n: str) -> DataFrame:
    """Adds total: the sum up to each period."""
    return flows.withColumn("total", F.sum(n).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """At most n rows of each stratum, by the digest of the key: a sampling operator, the same in every run."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")
