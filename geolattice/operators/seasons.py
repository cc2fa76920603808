"""Rules on series: anomalies that persist, peers of the same month, prorated months, candidates by tier, ageing curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def minus_reference(values: DataFrame, keys: list[str], value: str, reference: Column) -> DataFrame:
    """Adds gap: the median of a key's value less that of the rows of the same key for which ``reference`` holds."""
    return values.groupBy(*keys).agg((F.median(F.when(~reference, F.col(value))) - F.median(F.when(reference, F.col(value)))).alias("gap"))


def persistent(yearly: DataFrame, unit: str, value: str, limit: float, share: float = 2 / 3, least: int = 3) -> DataFrame:
    """(unit, years, over, island): years with data, those at ``limit`` or more, and whether they are ceil(share * years) with ``least`` years of data."""
    n = yearly.groupBy(unit).agg(F.count(value).alias("years"), F.count_if(F.col(value) >= limit).alias("over"))
    return n.withColumn("island", (F.col("over") >= F.ceil(F.lit(share) * F.col("years") - 1e-9)) & (F.col("years") >= least))


def peer_deviation(months: DataFrame, day: str, value: str) -> DataFrame:
    """Adds deviation from the upper median of the same month in other years; null without peers.

    A year's months are few, so the peers of a month of the year are one group of a few values.
    """
    own = months.withColumns({"__m": F.month(day), "__y": F.year(day)})
    peers = own.groupBy("__m").agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col("__y").alias("y")))).alias("__all"))
    others = F.transform(F.filter("__all", lambda x: x["y"] != F.col("__y")), lambda x: x["v"])
    rest = own.join(peers, "__m").withColumn("__rest", others)
    upper = F.element_at("__rest", (F.floor(F.size("__rest") / 2) + 1).cast("int"))
    return rest.withColumn("deviation", F.when(F.size("__rest") > 0, F.col(value) - upper)).drop("__m", "__y", "__all", "__rest")


def flows_after(flows: DataFrame, month: str, n: str, day: Column) -> Column:
    """A sum over ``flows`` by month: what came after ``day``, the month of the day itself by its remaining days."""
    first, last = F.trunc(month, "month"), F.last_day(month)
    part = F.col(n) * F.datediff(last, day) / F.dayofmonth(last)
    return F.sum(F.when(first > day, F.col(n)).when(last >= day, part).otherwise(0.0))


def first_seen(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")


def tier_cut(days: DataFrame, value: str, tiers: list[float]) -> DataFrame:
    """Days within the first tier that any day reaches, and those of unknown value; all days if none reaches any."""
    tier = F.lit(len(tiers))
    for k, t in reversed(list(enumerate(tiers))):
        tier = F.when(F.col(value) <= t, k).otherwise(tier)
    ranked = days.withColumn("__t", F.when(F.col(value).isNotNull(), tier))
    best = ranked.agg(F.min("__t").alias("__best"))
    return ranked.join(F.broadcast(best)).filter(F.col("__t").isNull() | (F.col("__t") <= F.col("__best"))).drop("__t", "__best")


def best_measured(candidates: DataFrame, keys: list[str], stated: str, measured: str, n: int = 4, most: float = 10.0) -> DataFrame:
    """Of the ``n`` candidates of a key with the least stated cloud the one with the least measured cloud, if that is at most ``most``."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(F.col(stated), F.lit(99)), "day")
    few = candidates.withColumn("__k", F.row_number().over(w)).filter((F.col("__k") <= n) & (F.col(measured) <= most))
    return few.groupBy(*keys).agg(F.min_by(F.struct("day", measured), F.struct(F.col(measured), F.col("__k"))).alias("x")).select(*keys, "x.*")


def ageing_curve(curves: DataFrame, age: str, share: str) -> DataFrame:
    """(age, reference, low, high): median and quartiles of the share at each age."""
    at = lambda q: F.expr(f"percentile({share}, {q})")
    return curves.groupBy(age).agg(F.median(share).alias("reference"), at(0.25).alias("low"), at(0.75).alias("high"))


def ageing_class(ratio: Column, reference: Column) -> Column:
    """baja, media or alta: cut where the share is a third and two thirds of what the reference has at the class age."""
    return F.when(ratio < (1 / 3) / reference, "baja").when(ratio >= (2 / 3) / reference, "alta").when(ratio.isNotNull(), "media")


def merged_months(stored: DataFrame, fresh: DataFrame, current: str, month: str = "month") -> DataFrame:
    """A monthly table after another run: months before ``current`` that are stored stay as they are, also when they are empty."""
    fixed = stored.filter(F.col(month) < current)
    return fixed.unionByName(fresh.join(fixed.select(month).distinct(), month, "left_anti"))
