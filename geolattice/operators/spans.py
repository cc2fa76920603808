"""Masks as runs of cells: rows of (key, r, c0, c1), both ends included, so that a mask costs its outline and not its area.

Sets are united, cut and subtracted by merging the ends of runs along each row; no run is ever opened into cells.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.operators.components import connected_components


def of_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """Runs of distinct cells (keys, r, c)."""
    own = cells.select(*keys, F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct()
    run = F.col("c") - F.row_number().over(Window.partitionBy(*keys, "r").orderBy("c"))
    return own.withColumn("__run", run).groupBy(*keys, "r", "__run").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).drop("__run")


def of_polygons(edges: DataFrame) -> DataFrame:
    """Runs (poly, r, c0, c1) of cells whose centre lies inside by the even-odd rule; edges (poly, x0, y0, x1, y1) in cell units."""
    first, last = F.ceil(F.least("y0", "y1") - 0.5), F.ceil(F.greatest("y0", "y1") - 0.5) - 1
    rows = edges.filter("y0 <> y1").withColumns({"a": first, "b": last}).filter("a <= b").withColumn("r", F.explode(F.sequence("a", "b")))
    crossed = rows.select("poly", "r", (F.col("x0") + (F.col("r") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    w = Window.partitionBy("poly", "r").orderBy("x")
    pairs = crossed.withColumns({"k": F.row_number().over(w), "next": F.lead("x").over(w)}).filter("k % 2 = 1 and next is not null")
    # what lies on the left edge is inside, on the right edge outside, as with any half-open run
    return pairs.select("poly", F.col("r").cast("long").alias("r"), F.ceil(F.col("x") - 0.5).alias("c0"), (F.ceil(F.col("next") - 0.5) - 1).alias("c1")).filter("c0 <= c1")


def scaled(spans: DataFrame, k: int) -> DataFrame:
    """Runs of a grid whose cells are k times as wide, on the fine grid."""
    return spans.withColumn("__d", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select((F.col("r") * k + F.col("__d")).alias("r"), (F.col("c0") * k).alias("c0"), (F.col("c1") * k + k - 1).alias("c1"))


def _ends(spans: DataFrame, name: str, names: list[str], keys: tuple[str, ...]) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("c0").alias("c"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("c"), F.lit(-1).alias("d")))).alias("e")
    return spans.select(*keys, F.col("r").alias("__r"), ends).select(*keys, "__r", F.col("e.c").alias("__c"), *[(F.col("e.d") if n == name else F.lit(0)).alias(n) for n in names])


def combine(sets: dict[str, DataFrame], keep: Column, *keys: str) -> DataFrame:
    """Runs (keys, r, c0, c1) where ``keep`` holds, a condition on the sets' names as booleans; runs of a set may overlap.

    One exchange by row, whatever the number of sets; what touches is one run.
    """
    names = list(sets)
    ends = reduce(DataFrame.unionByName, [_ends(s, n, names, keys) for n, s in sets.items()])
    sums = ends.groupBy(*keys, "__r", "__c").agg(*[F.sum(n).alias(n) for n in names])
    along = Window.partitionBy(*keys, "__r").orderBy("__c")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    inside = sums.select(*keys, "__r", "__c", *[(F.sum(n).over(upto) > 0).alias(n) for n in names]).select(*keys, "__r", "__c", keep.alias("__in"))
    turns = inside.withColumn("__was", F.coalesce(F.lag("__in").over(along), F.lit(False))).filter("__in <> __was")
    # starts and ends take turns
    runs = turns.withColumn("__end", F.lead("__c").over(along)).filter("__in")
    return runs.select(*keys, F.col("__r").alias("r"), F.col("__c").alias("c0"), (F.col("__end") - 1).alias("c1"))


def union(spans: DataFrame, *keys: str) -> DataFrame:
    """Each key's runs as one set, which counts no cell twice."""
    return combine({"a": spans}, F.col("a"), *keys)


def exclusive(horizons: DataFrame, order: str, values: list[int]) -> DataFrame:
    """(order, r, c0, c1): the cells of each horizon that no earlier one has; ``values`` are the horizons, first to last.

    Where runs overlap, the earliest horizon open there takes the cell: the whole chain of differences in one pass.
    """
    names = [f"h{k}" for k in range(len(values))]
    ends = horizons.filter(F.col(order).isin(values)).select("r", order, F.explode(F.array(F.struct(F.col("c0").alias("c"), F.lit(1).alias("d")), F.struct((F.col("c1") + 1).alias("c"), F.lit(-1).alias("d")))).alias("e"))
    sums = ends.groupBy("r", F.col("e.c").alias("c")).agg(*[F.sum(F.when(F.col(order) == v, F.col("e.d")).otherwise(0)).alias(n) for n, v in zip(names, values, strict=True)])
    along = Window.partitionBy("r").orderBy("c")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    first = F.coalesce(*[F.when(F.sum(n).over(upto) > 0, F.lit(v)) for n, v in zip(names, values, strict=True)])
    turns = sums.select("r", "c", first.alias("__h")).withColumn("__was", F.lag("__h").over(along)).filter("not (__h <=> __was)")
    runs = turns.withColumn("__end", F.lead("c").over(along)).filter("__h is not null")
    return runs.select(F.col("__h").alias(order), "r", F.col("c").alias("c0"), (F.col("__end") - 1).alias("c1"))


def cells_of(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, cells) of runs that don't overlap."""
    return spans.groupBy(*keys).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("cells"))


def located(cells: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Rows of cells (r, c, ...) with the key of the run they lie in, or null; runs mustn't overlap.

    The last run to begin at or before a cell is found along each row, as in an as-of join, so no cell meets all runs of its row.
    """
    rest = [c for c in cells.columns if c not in ("r", "c")]
    kind = dict(cells.dtypes)
    starts = spans.select("r", F.col("c0").alias("c"), F.struct(F.col(key).alias("k"), "c1").alias("__run"), *[F.lit(None).cast(kind[x]).alias(x) for x in rest], F.lit(0).alias("__cell"))
    own = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.lit(None).cast(starts.schema["__run"].dataType).alias("__run"), *rest, F.lit(1).alias("__cell"))
    along = Window.partitionBy("r").orderBy("c", "__cell").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(own).withColumn("__run", F.last("__run", ignorenulls=True).over(along)).filter("__cell = 1")
    return found.select("r", "c", *rest, F.when(F.col("__run.c1") >= F.col("c"), F.col("__run.k")).alias(key))


def _stretches(sets: dict[str, DataFrame]) -> DataFrame:
    """(__n, sets as booleans): stretches of __n cells of a row over which no set begins or ends."""
    names = list(sets)
    ends = reduce(DataFrame.unionByName, [_ends(s, n, names, ()) for n, s in sets.items()])
    along = Window.partitionBy("__r").orderBy("__c")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    sums = ends.groupBy("__r", "__c").agg(*[F.sum(n).alias(n) for n in names])
    return sums.select((F.lead("__c").over(along) - F.col("__c")).alias("__n"), *[(F.sum(n).over(upto) > 0).alias(n) for n in names]).filter("__n is not null")


def measured(sets: dict[str, DataFrame], parts: dict[str, Column]) -> DataFrame:
    """One row with the number of cells of each part, a condition on the sets' names as booleans; all in one pass over the rows."""
    return _stretches(sets).agg(*[F.coalesce(F.sum(F.when(keep, F.col("__n"))), F.lit(0).cast("long")).alias(name) for name, keep in parts.items()])


def shared(keyed: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """(key, r, c0, c1): what runs (key, r, c0, c1) that don't overlap each other share with a mask (r, c0, c1)."""
    d = lambda c, k, m, o: F.struct(F.col(c).alias("c") if c == "c0" else (F.col(c) + 1).alias("c"), k.alias("k"), m.alias("m"), o.alias("o"))
    kind = dict(keyed.dtypes)[key]
    none, zero = F.lit(None).cast(kind), F.lit(0)
    a = keyed.select("r", F.explode(F.array(d("c0", F.col(key).cast(kind), zero, F.lit(1)), d("c1", none, zero, F.lit(-1)))).alias("e"))
    b = mask.select("r", F.explode(F.array(d("c0", none, F.lit(1), zero), d("c1", none, F.lit(-1), zero))).alias("e"))
    sums = a.unionByName(b).groupBy("r", F.col("e.c").alias("c")).agg(F.max("e.k").alias("k"), F.sum("e.m").alias("m"), F.sum("e.o").alias("o"))
    along = Window.partitionBy("r").orderBy("c")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    # one run ends where the next begins, so the last key to begin is the open one
    now = sums.select("r", "c", (F.lead("c").over(along) - 1).alias("c1"), F.last("k", ignorenulls=True).over(upto).alias(key), (F.sum("m").over(upto) > 0).alias("__m"), (F.sum("o").over(upto) > 0).alias("__o"))
    return now.filter("__m and __o").select(key, "r", F.col("c").alias("c0"), "c1")


def _covered(spans: DataFrame, least: int, *keys: str) -> DataFrame:
    """Runs (keys, r, c0, c1) of cells that ``least`` runs or more cover."""
    ends = _ends(spans, "__n", ["__n"], keys).groupBy(*keys, "__r", "__c").agg(F.sum("__n").alias("__n"))
    along = Window.partitionBy(*keys, "__r").orderBy("__c")
    inside = ends.select(*keys, "__r", "__c", (F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, 0)) >= least).alias("__in"))
    turns = inside.withColumn("__was", F.coalesce(F.lag("__in").over(along), F.lit(False))).filter("__in <> __was").withColumn("__end", F.lead("__c").over(along)).filter("__in")
    return turns.select(*keys, F.col("__r").alias("r"), F.col("__c").alias("c0"), (F.col("__end") - 1).alias("c1"))


def _disc(spans: DataFrame, reach: int, sign: int) -> DataFrame:
    """Each run once for each row of a disc of cells around its own, longer (or with sign -1 shorter) by the disc's half width there."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.isqrt(reach * reach - k * k) * sign).alias("w")) for k in range(-reach, reach + 1)])
    rest = [c for c in spans.columns if c not in ("r", "c0", "c1")]
    return spans.withColumn("__d", F.explode(rows)).select(*rest, (F.col("r") + F.col("__d.k")).alias("r"), (F.col("c0") - F.col("__d.w")).alias("c0"), (F.col("c1") + F.col("__d.w")).alias("c1")).filter("c0 <= c1")


def grown(spans: DataFrame, reach: int, *keys: str) -> DataFrame:
    """All cells within ``reach`` of a cell of the runs, by straight distance."""
    return _covered(_disc(spans, reach, 1), 1, *keys)


def shrunk(spans: DataFrame, reach: int, *keys: str) -> DataFrame:
    """The cells whose whole disc of ``reach`` lies in the runs, which mustn't overlap or touch (as ``union`` gives them).

    A run that is shortened by the disc's width in each of its rows has the cells that it leaves there; a cell that all rows leave stays.
    """
    return _covered(_disc(spans, reach, -1), 2 * reach + 1, *keys)


def closed(spans: DataFrame, reach: int, *keys: str) -> DataFrame:
    """Runs grown by ``reach`` and shrunk again: gaps and inlets up to twice that wide are filled, the outline elsewhere stays."""
    return shrunk(grown(spans, reach, *keys), reach, *keys)


def zoned(spans: DataFrame, save, bucket: int = 256) -> DataFrame:
    """(r, c0, c1, zone) of runs that don't overlap or touch: zones join runs of adjacent rows that share a column; the least run's number names one."""
    own = save(spans.select("r", "c0", "c1").withColumn("node", F.monotonically_increasing_id()), "runs")
    spread = own.withColumn("b", F.explode(F.sequence(F.floor(F.col("c0") / bucket), F.floor(F.col("c1") / bucket))))
    above = spread.select((F.col("r") + 1).alias("r"), "b", F.col("c0").alias("d0"), F.col("c1").alias("d1"), F.col("node").alias("dst"))
    edges = spread.join(above, ["r", "b"]).filter("c0 <= d1 and d0 <= c1").select(F.col("node").alias("src"), "dst")
    return own.join(connected_components(edges, save), "node", "left").select("r", "c0", "c1", F.coalesce("component", "node").alias("zone"))


def fused(parts: DataFrame, part: str, reach: int, save) -> tuple[DataFrame, DataFrame]:
    """((part, zone, cells), (zone, name, parts, cells)): parts (part, r, c0, c1) that become one when closed by ``reach``, and the zones, named by
    their largest part (the least of equals). Parts may overlap; each lies in one zone."""
    own = save(union(parts, part), "parts")
    zones = save(zoned(closed(union(own), reach), save), "zones")
    # a part is in one zone, so one of its cells tells which
    at = own.groupBy(part).agg(F.min(F.struct("r", "c0")).alias("m"), F.sum(F.col("c1") - F.col("c0") + 1).alias("cells")).select(part, "cells", F.col("m.r").alias("r"), F.col("m.c0").alias("c"))
    of = save(located(at, zones, "zone").select(part, "zone", "cells"), "zones-of-parts")
    named = of.groupBy("zone").agg(F.min_by(part, F.struct(-F.col("cells"), part)).alias("name"), F.count("*").alias("parts"))
    return of, cells_of(zones, "zone").join(named, "zone").select("zone", "name", "parts", "cells")
