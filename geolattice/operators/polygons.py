"""Polygons on the grid, as edges: rows of (poly, x0, y0, x1, y1) in cell units, holes by parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(rings: DataFrame) -> DataFrame:
    """From (poly, ring, points: array of struct x, y) the edges of closed rings."""
    return rings.select("poly", F.explode(F.expr("transform(sequence(0, size(points) - 1), i -> struct(points[i].x as x0, points[i].y as y0, points[(i + 1) % size(points)].x as x1, points[(i + 1) % size(points)].y as y1))")).alias("e")).select("poly", "e.*")


def scanline_mask(polygon_edges: DataFrame, width: int, height: int) -> DataFrame:
    """(poly, r, c) of the cells whose centre lies inside by the even-odd rule.

    An edge meets the rows between its ends; the crossings of a row, in order, pair up, and the cells between a pair are inside. Work and
    rows grow with the outline and the area covered, and no cell meets every edge.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.lit(height - 1))
    rows = polygon_edges.filter("y0 <> y1").withColumn("a", first).withColumn("b", last).filter("a <= b").withColumn("r", F.explode(F.sequence("a", "b")))
    crossed = rows.select("poly", "r", (F.col("x0") + (F.col("r") + 0.5 - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))).alias("x"))
    w = Window.partitionBy("poly", "r").orderBy("x")
    pairs = crossed.withColumns({"k": F.row_number().over(w), "next": F.lead("x").over(w)}).filter("k % 2 = 1 and next is not null")
    spans = pairs.withColumns({"c0": F.greatest(F.ceil(F.col("x") - 0.5), F.lit(0)), "c1": F.least(F.floor(F.col("next") - 0.5), F.lit(width - 1))}).filter("c0 <= c1")
    return spans.select("poly", "r", F.explode(F.sequence("c0", "c1")).alias("c")).distinct()


def points_in_polygons(points: DataFrame, polygon_edges: DataFrame, bucket: float = 1.0, wide: float | None = None) -> DataFrame:
    """(id, poly) of each point (id, x, y) and the polygons around it, by the parity of crossings to its right.

    Points and edges meet in strips of y, so a point is compared with the edges of its strip alone; with ``wide``, about a polygon's width,
    strips are cut across too, and a polygon's edges are in the parts from its left end on. Both sides are dealt by strip, as neither's
    size is known before its rows are made.
    """
    strip = lambda y: F.floor(y / bucket)
    at = ["strip"]
    cut, asked = polygon_edges.filter("y0 <> y1"), points.withColumn("strip", strip(F.col("y")))
    if wide:
        at.append("part")
        cut = cut.withColumn("__left", F.min(F.least("x0", "x1")).over(Window.partitionBy("poly"))).withColumn("part", F.explode(F.sequence(F.floor(F.col("__left") / wide), F.floor(F.greatest("x0", "x1") / wide)))).drop("__left")
        asked = asked.withColumn("part", F.floor(F.col("x") / wide))
    cut = cut.withColumn("strip", F.explode(F.sequence(strip(F.least("y0", "y1")), strip(F.greatest("y0", "y1")))))
    met = asked.join(cut.hint("merge"), at)
    crosses = ((F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))) & (F.col("x") < (F.col("x1") - F.col("x0")) * (F.col("y") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    return met.filter(crosses).groupBy("id", "poly").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("id", "poly")


def first_containing(points: DataFrame, polygon_edges: DataFrame, bucket: float = 1.0) -> DataFrame:
    """(id, poly) of every point with the first polygon that contains it, or null outside all."""
    found = points_in_polygons(points, polygon_edges, bucket).groupBy("id").agg(F.min("poly").alias("poly"))
    return points.select("id").join(found, "id", "left")


def hexagon(x, y, side: float):
    """Column pair (q, r): the axial place of the pointy-top hexagon of a point, by cube rounding."""
    q, r = (3**0.5 / 3 * x - y / 3) / side, (2.0 / 3 * y) / side
    s = -q - r
    rq, rr, rs = (F.floor(v + 0.5) for v in (q, r, s))
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    return F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq), F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
