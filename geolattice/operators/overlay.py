"""Polygons laid over polygons, as edges (poly, x0, y0, x1, y1) that have the inside to their left: holes run clockwise.

Areas come from signed trapezoids, boundaries of unions from the arrangement of edges. Polygons meet where their boxes share a cell of a
grid, edges of a pair where they share a strip, so that no polygon meets all others and no edge all edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is nearer to an edge than this, times the edge's length, lies on it.
NEAR = 1e-9


def oriented(rings: DataFrame) -> DataFrame:
    """Edges of (poly, ring, points: array of struct x, y), ring 0 the outer one, in any direction; rings close themselves.

    Rings that are null or have fewer than three points give no edges.
    """
    cross = "aggregate(sequence(0, size(points) - 1), 0D, (s, i) -> s + points[i].x * points[(i + 1) % size(points)].y - points[(i + 1) % size(points)].x * points[i].y)"
    turned = rings.filter("size(points) >= 3").withColumn("points", F.expr(f"if(({cross} > 0) = (ring = 0), points, reverse(points))"))
    pairs = F.expr("transform(sequence(0, size(points) - 1), i -> struct(points[i].x as x0, points[i].y as y0, points[(i + 1) % size(points)].x as x1, points[(i + 1) % size(points)].y as y1))")
    return turned.select("poly", F.explode(pairs).alias("e")).select("poly", "e.*").filter("x0 <> x1 or y0 <> y1")


def areas(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, area) of what edges enclose."""
    keys = keys or ("poly",)
    return edges.groupBy(*keys).agg((F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2).alias("area"))


def boxes(edges: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("poly",)
    return edges.groupBy(*keys).agg(F.min("x0").alias("left"), F.max("x0").alias("right"), F.min("y0").alias("low"), F.max("y0").alias("high"))


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def box_pairs(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a, b, left, right, base): polygons whose boxes meet, the x that both have, and a y below both.

    A pair is found in every cell that both boxes touch and kept in the first of them alone. ``cell`` should be about the size of the
    smaller polygons' boxes. The join is a merge: rows that explode makes aren't in the sizes by which Spark would broadcast a side.
    """

    def spread(edges: DataFrame, name: str) -> DataFrame:
        own = boxes(edges).select(F.col("poly").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("left", "right", "low", "high")])
        return own.withColumn("i", F.explode(_cells(F.col(f"{name}_left"), F.col(f"{name}_right"), cell))).withColumn("j", F.explode(_cells(F.col(f"{name}_low"), F.col(f"{name}_high"), cell)))

    left, low = F.greatest("a_left", "b_left"), F.greatest("a_low", "b_low")
    met = spread(a, "a").join(spread(b, "b").hint("merge"), ["i", "j"]).filter((left < F.least("a_right", "b_right")) & (low < F.least("a_high", "b_high")))
    met = met.filter((F.col("i") == F.floor(left / cell)) & (F.col("j") == F.floor(low / cell)))
    return met.select("a", "b", left.alias("left"), F.least("a_right", "b_right").alias("right"), F.least("a_low", "b_low").alias("base"))


def intersection_areas(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(a, b, area) of polygons that share some area, holes taken out.

    Between its edge and a level below both, each edge spans a trapezoid, whose sign is its direction; the signed trapezoids of
    one polygon add up to it, so the signed common areas of two polygons' trapezoids add up to theirs.
    """
    pairs = box_pairs(a, b, cell)

    def pieces(edges: DataFrame, name: str) -> DataFrame:
        own = pairs.join(edges.withColumnRenamed("poly", name).hint("merge"), name)
        l, r = F.greatest(F.least("x0", "x1"), "left"), F.least(F.greatest("x0", "x1"), "right")
        own = own.withColumns({"__l": l, "__r": r}).filter("__l < __r").withColumn("s", F.explode(_cells(F.col("__l"), F.col("__r"), cell)))
        l, r = F.greatest("__l", F.col("s") * cell), F.least("__r", (F.col("s") + 1) * cell)
        slope = (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
        return own.select("a", "b", "s", l.alias(f"{name}l"), r.alias(f"{name}r"), slope.alias(f"{name}k"), (F.col("y0") - F.col("base") - F.col("x0") * slope).alias(f"{name}c"), F.signum(F.col("x0") - F.col("x1")).alias(f"{name}s")).filter(f"{name}l < {name}r")

    met = pieces(a, "a").join(pieces(b, "b").hint("merge"), ["a", "b", "s"]).withColumns({"l": F.greatest("al", "bl"), "r": F.least("ar", "br")}).filter("l < r")
    at = lambda n, x: F.col(f"{n}c") + F.col(f"{n}k") * F.col(x)
    al, ar, bl, br = at("a", "l"), at("a", "r"), at("b", "l"), at("b", "r")
    width, d0, d1 = F.col("r") - F.col("l"), al - bl, ar - br
    t = d0 / (d0 - d1)
    middle = al + t * (ar - al)
    least = F.when(d0 * d1 >= 0, (F.least(al, bl) + F.least(ar, br)) / 2).otherwise((F.least(al, bl) + middle) / 2 * t + (middle + F.least(ar, br)) / 2 * (1 - t))
    # rounding leaves a little of pairs that only touch
    return met.groupBy("a", "b").agg(F.sum(F.col("as") * F.col("bs") * width * least).alias("area")).filter("area > 1e-7")


def shares(a: DataFrame, shared: DataFrame, outside) -> DataFrame:
    """(a, b, area, share) with a row ``outside`` for what each polygon of ``a`` has outside all of b; polygons of b mustn't overlap each other."""
    own = areas(a).select(F.col("poly").alias("a"), F.col("area").alias("__own"))
    inside = shared.groupBy("a").agg(F.sum("area").alias("__in"))
    rest = own.join(inside.hint("merge"), "a", "left").select("a", F.lit(outside).alias("b"), F.greatest(F.col("__own") - F.coalesce("__in", F.lit(0.0)), F.lit(0.0)).alias("area"))
    return shared.select("a", "b", "area").unionByName(rest).join(own.hint("merge"), "a").select("a", "b", "area", (F.col("area") / F.col("__own")).alias("share"))


def _crossings(edges: DataFrame, cell: float) -> DataFrame:
    """(edge, t): where along an edge (0 to 1) edges of other polygons of its group cross it, or end on it."""
    own = edges.withColumn("i", F.explode(_cells(F.least("x0", "x1"), F.greatest("x0", "x1"), cell))).withColumn("j", F.explode(_cells(F.least("y0", "y1"), F.greatest("y0", "y1"), cell)))
    other = own.select("g", "i", "j", F.col("poly").alias("__poly"), *[F.col(c).alias(c.replace("x", "u").replace("y", "v")) for c in ("x0", "y0", "x1", "y1")])
    met = own.join(other, ["g", "i", "j"]).filter("poly <> __poly and least(x0, x1) <= greatest(u0, u1) and least(u0, u1) <= greatest(x0, x1) and least(y0, y1) <= greatest(v0, v1) and least(v0, v1) <= greatest(y0, y1)")
    met = met.withColumns({"dx": F.expr("x1 - x0"), "dy": F.expr("y1 - y0"), "ex": F.expr("u1 - u0"), "ey": F.expr("v1 - v0")}).withColumns({"k": F.expr("dx * ey - dy * ex"), "n": F.expr("dx * dx + dy * dy")})
    met = met.withColumn("flat", F.expr(f"abs(k) <= {NEAR} * sqrt(n * (ex * ex + ey * ey))"))
    # edges that run alongside are cut where the others end; whether they lie on each other shows later
    t = F.expr("((u0 - x0) * ey - (v0 - y0) * ex) / if(flat, null, k)")
    s = F.expr("((u0 - x0) * dy - (v0 - y0) * dx) / if(flat, null, k)")
    ends = F.array(F.expr("((u0 - x0) * dx + (v0 - y0) * dy) / n"), F.expr("((u1 - x0) * dx + (v1 - y0) * dy) / n"))
    cuts = met.select("edge", F.explode(F.when(F.col("flat"), ends).otherwise(F.array(F.when((s >= -NEAR) & (s <= 1 + NEAR), t)))).alias("t"))
    return cuts.filter(f"t > {NEAR} and t < 1 - {NEAR}").select("edge", F.round("t", 12).alias("t")).distinct()


def dissolve(edges: DataFrame, group: Column, cell: float, save) -> DataFrame:
    """(g, x0, y0, x1, y1): the boundary of the union of each group's polygons, in pieces with the inside to their left.

    Edges are cut where edges of other polygons of the group cross them; a piece is boundary if its middle is inside none of these. Of
    pieces that lie on each other one stays if they run alike, and none if they run against each other.
    """
    own = save(edges.withColumn("g", group).withColumn("edge", F.monotonically_increasing_id()), "edges")
    cuts = _crossings(own, cell).groupBy("edge").agg(F.array_sort(F.collect_list("t")).alias("t"))  # what crosses one edge
    ts = F.concat(F.array(F.lit(0.0)), F.coalesce("t", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    cut = own.join(cuts, "edge", "left").withColumn("t", ts).withColumn("__k", F.explode(F.expr("sequence(0, size(t) - 2)")))
    on = lambda v, k: F.expr(f"if(t[{k}] = 1, {v}1, {v}0 + t[{k}] * ({v}1 - {v}0))")
    parts = cut.select("g", "poly", on("x", "__k").alias("x0"), on("y", "__k").alias("y0"), on("x", "__k + 1").alias("x1"), on("y", "__k + 1").alias("y1"))
    parts = save(parts.withColumn("piece", F.monotonically_increasing_id()).withColumns({"mx": F.expr("(x0 + x1) / 2"), "my": F.expr("(y0 + y1) / 2")}), "pieces")
    # each middle meets the edges of its strip, of polygons whose box holds it
    near = boxes(own, "g", "poly").withColumn("i", F.explode(_cells(F.col("left"), F.col("right"), cell))).withColumn("j", F.explode(_cells(F.col("low"), F.col("high"), cell)))
    near = near.select("g", F.col("poly").alias("__poly"), "i", "j", "left", "right", "low", "high")
    asked = parts.withColumns({"i": F.floor(F.col("mx") / cell), "j": F.floor(F.col("my") / cell)}).join(near, ["g", "i", "j"])
    asked = asked.filter(f"poly <> __poly and mx >= left - {NEAR} and mx <= right + {NEAR} and my >= low - {NEAR} and my <= high + {NEAR}")
    sides = own.select("g", F.col("poly").alias("__poly"), *[F.col(c).alias(c.replace("x", "u").replace("y", "v")) for c in ("x0", "y0", "x1", "y1")])
    sides = sides.withColumn("j", F.explode(_cells(F.least("v0", "v1") - NEAR, F.greatest("v0", "v1") + NEAR, cell)))
    met = asked.select("g", "piece", "poly", "__poly", "j", "mx", "my", F.expr("x1 - x0").alias("dx"), F.expr("y1 - y0").alias("dy")).join(sides, ["g", "__poly", "j"])
    length = "sqrt((u1 - u0) * (u1 - u0) + (v1 - v0) * (v1 - v0))"
    lies = f"abs((u1 - u0) * (my - v0) - (v1 - v0) * (mx - u0)) <= {NEAR} * 1000 * {length} and (mx - u0) * (mx - u1) + (my - v0) * (my - v1) <= 0"
    right = "(v0 > my) <> (v1 > my) and mx < (u1 - u0) * (my - v0) / (v1 - v0) + u0"
    alike = F.expr("dx * (u1 - u0) + dy * (v1 - v0) > 0")
    found = met.groupBy("piece", "poly", "__poly").agg(F.sum(F.expr(right).cast("int")).alias("n"), F.bool_or(F.expr(lies)).alias("on"), F.bool_or(F.expr(lies) & alike).alias("alike"))
    gone = found.filter("if(on, not alike or __poly < poly, n % 2 = 1)").select("piece").distinct()
    return parts.join(gone, "piece", "left_anti").select("g", "x0", "y0", "x1", "y1")
