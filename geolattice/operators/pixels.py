"""Operators on cells of a common grid: rows of (scene, r, c, bands), joined on the cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolattice.functions import radiometry as R
from geolattice.functions.order_stats import rank_percentiles
from geolattice.operators import polygons as G

CELL = ["r", "c"]


def first_valid(pixels: DataFrame, bands: list[str], priority: Column) -> DataFrame:
    """For each cell the scene of least priority in which every band is valid, taken as a whole; ``src`` names it."""
    whole = pixels.filter(" and ".join(f"{b} is not null" for b in bands))
    best = whole.groupBy(*CELL).agg(F.min_by(F.struct(F.col("scene").alias("src"), *bands), F.struct(priority, F.col("scene"))).alias("x"))
    return best.select(*CELL, "x.*")


def gap_fill(pixels: DataFrame, bands: list[str], priority: Column) -> DataFrame:
    """For each cell and band on its own the first valid value by priority."""
    return pixels.groupBy(*CELL).agg(*[F.min_by(b, F.when(F.col(b).isNotNull(), priority)).alias(b) for b in bands])


def composite(pixels: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Median over time of each cell, and the observations it rests on."""
    return pixels.withColumn("__v", value).groupBy(*CELL).agg(F.median("__v").alias(name), F.count("__v").alias("n_obs"))


def two_dates(pixels: DataFrame, before: int, after: int, values: dict[str, Column]) -> DataFrame:
    """Cells of both scenes with ``values`` as name_0 and name_1."""
    side = lambda scene, k: pixels.filter(F.col("scene") == scene).select(*CELL, *[v.alias(f"{n}_{k}") for n, v in values.items()])
    return side(before, 0).join(side(after, 1), CELL)


def construction(pixels: DataFrame, before: int, after: int, *, rise: float = 0.08, green_after: float = 0.3, green_before: float | None = 0.35) -> DataFrame:
    """Comparable cells with ``state``: construction, vegetation_loss (it was greener than ``green_before``) or none.

    A cell is comparable if NDBI and NDVI are valid on both dates. It changed if NDBI rose by ``rise``, NDVI ended at ``green_after`` or
    less, and it isn't water; where MNDWI is missing it counts as land. All bounds are inclusive.
    """
    both = two_dates(pixels, before, after, {n.lower(): R.index(n) for n in ("NDBI", "NDVI", "MNDWI")})
    both = both.filter("ndbi_0 is not null and ndbi_1 is not null and ndvi_0 is not null and ndvi_1 is not null")
    land = ~F.coalesce(F.col("mndwi_1") >= 0, F.lit(False))
    changed = (F.col("ndbi_1") - F.col("ndbi_0") >= rise) & (F.col("ndvi_1") <= green_after) & land
    bare = F.lit(True) if green_before is None else F.col("ndvi_0") <= green_before
    return both.withColumn("state", F.when(changed & bare, "construction").when(changed, "vegetation_loss").otherwise("none"))


def bare_soil(pixels: DataFrame, before: int, after: int, limit: float = 0.2) -> DataFrame:
    """Comparable cells with ``bare``: NDVI under the limit on both dates and no water on either."""
    both = two_dates(pixels, before, after, {"ndvi": R.index("NDVI"), "mndwi": R.index("MNDWI")}).filter("ndvi_0 is not null and ndvi_1 is not null")
    dry = ~F.coalesce(F.greatest("mndwi_0", "mndwi_1") > 0, F.lit(False))
    return both.withColumn("bare", (F.col("ndvi_0") < limit) & (F.col("ndvi_1") < limit) & dry)


def class_areas(cells: DataFrame, cls: str, hectares: float) -> DataFrame:
    """(class, cells, ha, pct) with the share of all classified cells."""
    counts = cells.filter(F.col(cls).isNotNull()).groupBy(cls).agg(F.count("*").alias("cells"))
    total = counts.agg(F.sum("cells").alias("__all"))
    return counts.join(F.broadcast(total)).select(F.col(cls).alias("class"), "cells", (F.col("cells") * hectares).alias("ha"), (100.0 * F.col("cells") / F.col("__all")).alias("pct"))


def boundary(cells: DataFrame) -> DataFrame:
    """Cells of a set with a 4-neighbour outside it."""
    near = F.explode(F.array(*[F.struct((F.col("r") + a).alias("nr"), (F.col("c") + b).alias("nc")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    sides = cells.select(*CELL, near.alias("x")).select(*CELL, "x.*")
    inside = cells.select(F.col("r").alias("nr"), F.col("c").alias("nc")).distinct()
    return sides.join(inside, ["nr", "nc"], "left_anti").select(*CELL).distinct()


def coarser(cells: DataFrame, factor: int, flag: Column) -> DataFrame:
    """Share of a flag in blocks of factor by factor cells."""
    return cells.groupBy((F.floor(F.col("r") / factor)).alias("r"), (F.floor(F.col("c") / factor)).alias("c")).agg(F.avg(flag.cast("double")).alias("share"), F.count("*").alias("n"))


def built_since(cells: DataFrame, year: str, flag: str) -> DataFrame:
    """First year from which on a cell is built in every later year; cells not built at the end are left out."""
    later = Window.partitionBy(*CELL).orderBy(F.desc(year)).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("__on", F.min(F.col(flag).cast("int")).over(later)).filter("__on = 1").groupBy(*CELL).agg(F.min(year).alias("since"))


def drop_clouds(pixels: DataFrame, state: Column, bands: list[str]) -> DataFrame:
    """Bands are null where the state isn't clear."""
    return pixels.withColumns({b: F.when(state == R.CLEAR, F.col(b)) for b in bands})


def full_coverage(footprints: DataFrame, width: float, height: float, side: int = 7, least: float = 0.9) -> DataFrame:
    """(day, share): days whose footprints (day, poly, points) cover ``least`` of a lattice of side by side probes; every day if none does.

    Footprints of equal outline are tested once.
    """
    probes = footprints.sparkSession.range(side * side).select("id", ((F.col("id") % side + 0.5) * width / side).alias("x"), ((F.floor(F.col("id") / side) + 0.5) * height / side).alias("y"))
    inside = G.points_in_polygons(probes, G.edges(footprints.select("poly", "points").dropDuplicates(["poly"])))
    hits = footprints.select("day", "poly").join(inside, "poly").groupBy("day").agg(F.count_distinct("id").alias("n"))
    shares = footprints.select("day").distinct().join(hits, "day", "left").select("day", (F.coalesce("n", F.lit(0)) / (side * side)).alias("share"))
    best = shares.agg(F.max("share").alias("__best"))
    return shares.join(F.broadcast(best)).filter((F.col("share") >= least) | (F.col("__best") < least)).drop("__best")


def change_report(deltas: DataFrame, value: str, threshold: float, hectares: float, moved: float) -> DataFrame:
    """One row: limit_ (twice the threshold, or the larger of the 2nd and 98th percentile by size), hectares down, stable and up, mean,
    upper median and whether that moved by ``moved`` (then the change is one of season)."""
    p = rank_percentiles(deltas, [], value, {"lo": 0.02, "hi": 0.98, "mid": 0.5})
    d = F.col(value)
    sums = deltas.agg((F.count_if(d <= -threshold) * hectares).alias("down_ha"), (F.count_if((d > -threshold) & (d < threshold)) * hectares).alias("stable_ha"), (F.count_if(d >= threshold) * hectares).alias("up_ha"), F.round(F.avg(d), 6).alias("mean"))
    limit = F.round(F.greatest(F.lit(2 * threshold), F.abs("lo"), F.abs("hi")), 9)
    return sums.join(F.broadcast(p)).select(limit.alias("limit_"), "down_ha", "stable_ha", "up_ha", "mean", F.round("mid", 9).alias("upper_median"), (F.abs("mid") >= moved).alias("greening"))


def true_colour(scene: DataFrame, bands: list[str], shares: tuple[float, float], gamma: float) -> DataFrame:
    """Bytes of bands stretched each between two of its percentiles and raised to ``gamma``; cells with every band valid."""
    out = scene.filter(" and ".join(f"{b} is not null" for b in bands))
    for b in bands:
        p = rank_percentiles(scene, [], b, {"lo": shares[0], "hi": shares[1]}).select(F.round("lo", 9).alias(f"__lo_{b}"), F.round("hi", 9).alias(f"__hi_{b}"))
        out = out.join(F.broadcast(p))
    span = lambda b: F.when(F.col(f"__hi_{b}") == F.col(f"__lo_{b}"), F.lit(1.0)).otherwise(F.col(f"__hi_{b}") - F.col(f"__lo_{b}"))
    scaled = lambda b: F.least(F.greatest((F.col(b) - F.col(f"__lo_{b}")) / span(b), F.lit(0.0)), F.lit(1.0))
    return out.withColumns({b: F.floor(F.pow(scaled(b), F.lit(gamma)) * 255 + 0.5).cast("long") for b in bands}).drop(*[f"__{k}_{b}" for k in ("lo", "hi") for b in bands])


def square(r: Column, c: Column, side: int = 1) -> Column:
    """A cell, or a square of cells, as a closed ring of five points in JSON."""
    corners = ((0, 0), (side, 0), (side, side), (0, side), (0, 0))
    points = [F.concat(F.lit("["), (c + a).cast("string"), F.lit(","), (r + b).cast("string"), F.lit("]")) for a, b in corners]
    return F.concat(F.lit("["), F.concat_ws(",", *points), F.lit("]"))
