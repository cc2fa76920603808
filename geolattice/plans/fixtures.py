"""Tables of the kind that the operators read, derived from the given star schema; each in Spark and as SQL of the same meaning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions.radiometry import reflectance
from geolattice.session import table

BANDS = {"red": "l_returnflag = 'N'", "nir": "l_returnflag = 'A'", "swir1": "l_returnflag = 'R'", "green": "l_linestatus = 'O'"}

#: Cells on a side of the grid, 32 or more: it grows with the table, so that a cell has about as many rows at any size.
SIDE = "(select greatest(32, floor(sqrt(10 * max(s_suppkey)))::bigint) from supplier)"
PIXELS = f"px as (select year(l_shipdate)::int as scene, l_partkey % {SIDE} as r, l_suppkey % {SIDE} as c, " + ", ".join(
    f"nullif(coalesce(sum(case when {w} then l_quantity end), 0), 0) * 0.01 as {b}" for b, w in BANDS.items()
) + ", (sum(l_linenumber) % 12)::int as cls, (sum(l_linenumber) % 64)::int as bits from lineitem group by 1, 2, 3)"
SCENES = """sc as (select o_orderkey as scene_id, o_orderdate::timestamp as ts, o_orderdate::date as day, case when o_orderstatus = 'P' then null else floor(o_totalprice)::bigint % 100 end as cloud,
 o_custkey % 2 as tile from orders)"""
POLYGONS = {
    "a": [[(1.2, 0.3), (7.1, 1.0), (6.4, 7.6), (0.6, 6.1)], [(3, 3), (5, 3), (5, 5), (3, 5)]],
    "b": [[(10.5, 10.5), (30.2, 12.25), (20.75, 29.5)]],
    "c": [[(0, 20), (12, 20), (12, 31.5), (0, 31.5)]],
}
#: Polygons are drawn on 32 cells and stretched over the grid.
EDGES = f"edges as (select poly, " + ", ".join(f"{v} * ({SIDE} / 32.0::double) as {v}" for v in ("x0", "y0", "x1", "y1")) + " from (values " + ", ".join(f"('{p}', {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for p, rs in POLYGONS.items() for ring in rs for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) + ") v(poly, x0, y0, x1, y1))"
INSIDE = EDGES + f""", crossing as (select poly, r, (y0 - r - 0.5) / (y0 - y1) * (x1 - x0) + x0 as x from edges, (select unnest(range({SIDE})) as r) t where (y0 > r + 0.5) <> (y1 > r + 0.5)),
 paired as (select *, row_number() over (partition by poly, r order by x) as k, lead(x) over (partition by poly, r order by x) as x2 from crossing),
 inside as (select distinct poly, r, c from paired, (select unnest(range({SIDE})) as c) u where k % 2 = 1 and c between ceil(x - 0.5) and floor(x2 - 0.5))"""


def side(spark: SparkSession, folder: str) -> int:
    return max(32, math.isqrt(10 * (table(spark, folder, "supplier").agg(F.max("s_suppkey")).first()[0] or 0)))


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """A scene for each ship year on a grid of side by side cells."""
    n = side(spark, folder)
    sums = [F.coalesce(F.sum(F.when(F.expr(w), F.col("l_quantity"))), F.lit(0)).alias(b) for b, w in BANDS.items()]
    more = [(F.sum("l_linenumber") % n).cast("int").alias(name) for name, n in (("cls", 12), ("bits", 64))]
    cells = table(spark, folder, "lineitem").groupBy(F.year("l_shipdate").alias("scene"), (F.col("l_partkey") % n).alias("r"), (F.col("l_suppkey") % n).alias("c")).agg(*sums, *more)
    return cells.withColumns({b: reflectance(F.col(b), 0.01) for b in BANDS})


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    cloud = F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice") % 100)
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("scene_id"), F.to_timestamp("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("day"), cloud.alias("cloud"), (F.col("o_custkey") % 2).alias("tile"))


def polygon_rings(spark: SparkSession, folder: str) -> DataFrame:
    k_ = side(spark, folder) / 32.0
    rows = [(p, k, [(float(x) * k_, float(y) * k_) for x, y in ring]) for p, rs in POLYGONS.items() for k, ring in enumerate(rs)]
    return spark.createDataFrame(rows, "poly string, ring int, points array<struct<x: double, y: double>>")
