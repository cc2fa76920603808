"""Queries on pixels: scaling, masks, mosaics, indices, change, zones and polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions import radiometry as R
from geolattice.functions.order_stats import rank_percentiles
from geolattice.operators import pixels as P
from geolattice.operators import polygons as G
from geolattice.operators.zones import FOUR, zones
from geolattice.plans.fixtures import INSIDE, PIXELS, SIDE, pixels, polygon_rings, side
from geolattice.plans.registry import query
from geolattice.session import saved

NDVI, NDBI, MNDWI, NDWI = "(nir - red) / nullif(nir + red, 0)", "(swir1 - nir) / nullif(swir1 + nir, 0)", "(green - swir1) / nullif(green + swir1, 0)", "(green - nir) / nullif(green + nir, 0)"
HA = 0.25
RULE = f"""{PIXELS}, ix as (select scene, r, c, {NDVI} as ndvi, {NDBI} as ndbi, {MNDWI} as mndwi from px),
 pair as (select a.r, a.c, a.ndvi as v0, b.ndvi as v1, a.ndbi as b0, b.ndbi as b1, a.mndwi as m0, b.mndwi as m1 from ix a join ix b using (r, c) where a.scene = 1995 and b.scene = 1996),
 ruled as (select r, c, case when b1 - b0 >= 0.08 and v1 <= 0.3 and not coalesce(m1 >= 0, false) then case when v0 <= 0.35 then 'construction' else 'vegetation_loss' end else 'none' end as state
 from pair where v0 is not null and v1 is not null and b0 is not null and b1 is not null)"""


def _ranks(value: str, source: str, key: str, shares: dict[str, float]) -> str:
    picks = ", ".join(f"round(max(case when k = least(n - 1, floor({s} * n)) then v end), 9) as {name}" for name, s in shares.items())
    return f"(select {key}, {picks} from (select {key}, {value} as v, row_number() over (partition by {key} order by {value}) - 1 as k, count(*) over (partition by {key}) as n from {source} where {value} is not null) group by 1)"


@query(f"with {PIXELS} select scene::bigint as scene, count(*) as cells, count(red) as red_valid, count(nir) as nir_valid, round(sum(red), 6) as red_sum, round(max(swir1), 6) as swir_max from px group by 1")
def pixel_scan(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder)
    return p.groupBy(F.col("scene").cast("long").alias("scene")).agg(F.count("*").alias("cells"), F.count("red").alias("red_valid"), F.count("nir").alias("nir_valid"), F.round(F.sum("red"), 6).alias("red_sum"), F.round(F.max("swir1"), 6).alias("swir_max"))


@query(f"with {PIXELS} select scene::bigint as scene, " + ", ".join(f"count({e}) as n_{n}, round(avg({e}), 6) as {n}" for n, e in (("ndvi", NDVI), ("ndwi", NDWI), ("mndwi", MNDWI), ("ndbi", NDBI))) + " from px group by 1")
def spectral_indices(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder)
    names = [n for n in ("NDVI", "NDWI", "MNDWI", "NDBI") if n in R.available_indices(p.columns)]
    return p.groupBy(F.col("scene").cast("long").alias("scene")).agg(*[x for n in names for x in (F.count(R.index(n)).alias(f"n_{n.lower()}"), F.round(F.avg(R.index(n)), 6).alias(n.lower()))])


@query(f"with {PIXELS}, ix as (select scene::bigint as scene, {NDVI} as v from px) select * from " + _ranks("v", "ix", "scene", {"p2": 0.02, "p50": 0.5, "p98": 0.98}))
def index_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder).select(F.col("scene").cast("long").alias("scene"), R.index("NDVI").alias("v"))
    done = rank_percentiles(p, ["scene"], "v", {"p2": 0.02, "p50": 0.5, "p98": 0.98})
    return done.select("scene", *[F.round(c, 9).alias(c) for c in ("p2", "p50", "p98")])


@query(f"""with {RULE}, d as (select case when v1 - v0 <= -0.1 then 'down' when v1 - v0 >= 0.1 then 'up' when v1 - v0 is not null then 'stable' end as class from pair)
 select class, count(*) as cells, count(*) * {HA} as ha, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from d where class is not null group by 1""")
def index_change(spark: SparkSession, folder: str) -> DataFrame:
    both = P.two_dates(pixels(spark, folder), 1995, 1996, {"ndvi": R.index("NDVI")})
    classes = both.withColumn("cls", R.change_class(F.col("ndvi_1") - F.col("ndvi_0"), 0.1))
    return P.class_areas(classes, "cls", HA).withColumn("pct", F.round("pct", 6))


@query(f"with {RULE} select state, count(*) as cells from ruled group by 1")
def construction_rule(spark: SparkSession, folder: str) -> DataFrame:
    return P.construction(pixels(spark, folder), 1995, 1996).groupBy("state").agg(F.count("*").alias("cells"))


def _zones_sql(near: str, least: int) -> str:
    return f"""with recursive {RULE}, own as (select r * 2147483648 + c as id, r, c from ruled where state <> 'none'),
 e as (select a.id as x, b.id as y from own a join own b on {near}), walk as (select id as x, id as y from own union select walk.x, e.y from walk join e on walk.y = e.x),
 z as (select x, min(y) as zone from walk group by 1)
 select zone, count(*) as cells, count(*) * {HA} as ha, round(avg(r) + 0.5, 6) as row, round(avg(c) + 0.5, 6) as col from z join own on own.id = z.x group by 1 having count(*) >= {least}"""


@query(_zones_sql("abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1", 2))
def construction_zones(spark: SparkSession, folder: str) -> DataFrame:
    changed = P.construction(pixels(spark, folder), 1995, 1996).filter("state <> 'none'")
    return zones(changed, saved, cell_ha=HA, min_ha=0.3).select("zone", "cells", "ha", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"))


@query(_zones_sql("abs(a.r - b.r) + abs(a.c - b.c) <= 1", 1))
def zones_of_four_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    changed = P.construction(pixels(spark, folder), 1995, 1996).filter("state <> 'none'")
    return zones(changed, saved, cell_ha=HA, neighbours=FOUR).select("zone", "cells", "ha", F.round("row", 6).alias("row"), F.round("col", 6).alias("col"))


@query(_zones_sql("abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1", 1) + " order by ha desc, zone limit 5")
def largest_zones(spark: SparkSession, folder: str) -> DataFrame:
    changed = P.construction(pixels(spark, folder), 1995, 1996).filter("state <> 'none'")
    return zones(changed, saved, cell_ha=HA).select("zone", "cells", "ha", F.round("row", 6).alias("row"), F.round("col", 6).alias("col")).orderBy(F.desc("ha"), "zone").limit(5)


@query(f"with {RULE} select count(*) as comparable, count(*) filter (where v0 < 0.2 and v1 < 0.2 and not coalesce(greatest(m0, m1) > 0, false)) as bare from pair where v0 is not null and v1 is not null")
def bare_soil(spark: SparkSession, folder: str) -> DataFrame:
    return P.bare_soil(pixels(spark, folder), 1995, 1996).agg(F.count("*").alias("comparable"), F.count_if("bare").alias("bare"))


@query(f"""with {PIXELS} select src::bigint as src, count(*) as cells, round(sum(red), 6) as red from (select scene as src, red, row_number() over (partition by r, c order by scene desc) as k from px
 where red is not null and nir is not null and swir1 is not null and green is not null) where k = 1 group by 1""")
def mosaic(spark: SparkSession, folder: str) -> DataFrame:
    whole = P.first_valid(pixels(spark, folder), ["red", "nir", "swir1", "green"], -F.col("scene"))
    return whole.groupBy(F.col("src").cast("long").alias("src")).agg(F.count("*").alias("cells"), F.round(F.sum("red"), 6).alias("red"))


@query(f"with {PIXELS} select r, c, round(arg_max(red, scene) filter (where red is not null), 6) as red, round(arg_max(nir, scene) filter (where nir is not null), 6) as nir from px group by 1, 2")
def gap_fill(spark: SparkSession, folder: str) -> DataFrame:
    done = P.gap_fill(pixels(spark, folder), ["red", "nir"], -F.col("scene"))
    return done.select("r", "c", F.round("red", 6).alias("red"), F.round("nir", 6).alias("nir"))


@query(f"""with {PIXELS}, s as (select scene::bigint as scene, case when cls in (0, 1, 3, 8, 9, 10, 11) then 1 else 0 end as a, case when bits & 1 <> 0 then 2 when bits & 62 <> 0 then 1 else 0 end as b, case when bits & 1 <> 0 then 2 when bits & 30 <> 0 then 1 else 0 end as d from px)
 select scene, count(*) filter (where a = 1) as class_cloud, count(*) filter (where b = 1) as bits_cloud, count(*) filter (where b = 2) as bits_nodata, count(*) filter (where d = 1) as without_snow, round(count(*) filter (where b = 1) / count(*) filter (where b <> 2), 6) as fraction from s group by 1""")
def cloud_masks(spark: SparkSession, folder: str) -> DataFrame:
    s = pixels(spark, folder).select(F.col("scene").cast("long").alias("scene"), R.scene_class_state(F.col("cls")).alias("a"), R.quality_state(F.col("bits")).alias("b"), R.quality_state(F.col("bits"), (1, 2, 3, 4)).alias("d"))
    return s.groupBy("scene").agg(F.count_if(F.col("a") == 1).alias("class_cloud"), F.count_if(F.col("b") == 1).alias("bits_cloud"), F.count_if(F.col("b") == 2).alias("bits_nodata"), F.count_if(F.col("d") == 1).alias("without_snow"), F.round(F.count_if(F.col("b") == 1) / F.count_if(F.col("b") != 2), 6).alias("fraction"))


@query(f"with {PIXELS}, v as (select r, c, {NDVI} as v from px) select r, c, round(median(v), 6) as value, count(v) as n_obs from v group by 1, 2")
def temporal_composite(spark: SparkSession, folder: str) -> DataFrame:
    done = P.composite(pixels(spark, folder), R.index("NDVI"))
    return done.select("r", "c", F.round("value", 6).alias("value"), "n_obs")


@query(f"with {PIXELS}, v as (select scene, {NDVI} as v from px), n as (select scene::bigint as scene, v, row_number() over (partition by scene order by v) - 1 as k, count(*) over (partition by scene) as n, count(*) over (partition by scene) / pow({SIDE}, 2) as fraction from v where v is not null) select scene, round(avg(v), 6) as mean, round(median(v), 6) as median, round(max(case when k = n // 2 then v end), 9) as upper_median, round(max(fraction), 6) as valid from n group by 1")
def series(spark: SparkSession, folder: str) -> DataFrame:
    v = pixels(spark, folder).select(F.col("scene").cast("long").alias("scene"), R.index("NDVI").alias("v"))
    upper = rank_percentiles(v, ["scene"], "v", {"upper_median": 0.5})
    return v.groupBy("scene").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"), F.round(F.count("v") / float(side(spark, folder) ** 2), 6).alias("valid")).join(upper, "scene").withColumn("upper_median", F.round("upper_median", 9))


@query(f"with {PIXELS}, k as (select r, c, max(case when scene = 1995 then {NDVI} end) as a, max(case when scene = 2000 then {NDVI} end) as b from px group by 1, 2), d as (select " + ", ".join(f"case when {x} is null then 0 when {x} < 0.2 then 1 when {x} < 0.4 then 2 when {x} < 0.6 then 3 else 4 end as c{x}" for x in "ab") + " from k) select ca::bigint as before, " + ", ".join(f"count(*) filter (where cb = {k}) as to_{k}" for k in range(5)) + " from d group by 1")
def transition_matrix(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder).filter("scene in (1995, 2000)").groupBy("r", "c").agg(*[F.max(F.when(F.col("scene") == s, R.index("NDVI"))).alias(n) for s, n in ((1995, "a"), (2000, "b"))])
    every = pixels(spark, folder).select("r", "c").distinct().join(p, ["r", "c"], "left")
    classes = every.select(R.vegetation_class(F.col("a")).cast("long").alias("before"), R.vegetation_class(F.col("b")).alias("after"))
    return classes.groupBy("before").pivot("after", list(range(5))).count().select("before", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"to_{k}") for k in range(5)])


@query(f"with {PIXELS}, t as (select scene::bigint as scene, red - 0.05 as k, red from px where red is not null) select scene, count(*) filter (where red <= pow(10, -5.0 / 10)) as water, round(avg(k * 100 - 273.15), 6) as celsius from t group by 1")
def water_and_heat(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder).filter("red is not null")
    return p.groupBy(F.col("scene").cast("long").alias("scene")).agg(F.count_if(R.backscatter_is_water(F.col("red"), -5.0)).alias("water"), F.round(F.avg(R.celsius((F.col("red") - 0.05) * 100)), 6).alias("celsius"))


@query(f"with {PIXELS}, w as (select r, c, max(case when scene = 1995 then red <= 0.4 end) as a, max(case when scene = 1997 then red <= 0.4 end) as b from px where red is not null group by 1, 2) select case when a and b then 'permanent' when b then 'new' when a then 'lost' else 'land' end as state, count(*) as cells from w where a is not null and b is not null group by 1")
def water_change(spark: SparkSession, folder: str) -> DataFrame:
    both = P.two_dates(pixels(spark, folder).filter("red is not null"), 1995, 1997, {"w": F.col("red") <= 0.4})
    state = F.when(F.col("w_0") & F.col("w_1"), "permanent").when(F.col("w_1"), "new").when(F.col("w_0"), "lost").otherwise("land")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("cells"))


@query(f"with {PIXELS}, v as (select r, c, red from px where scene = 1996), q as (select scene, p2, p98 from (select scene, red as v from px where scene = 1996) s join " + _ranks("red", "px", "scene", {"p2": 0.02, "p98": 0.98}) + " t using (scene) group by all) select r, c, floor(least(greatest((red - p2) / (p98 - p2), 0), 1) * 255 + 0.5)::bigint as grey from v, q where red is not null")
def grey_stretch(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder).filter("scene = 1996 and red is not null")
    q = rank_percentiles(p, ["scene"], "red", {"p2": 0.02, "p98": 0.98}).withColumns({c: F.round(c, 9) for c in ("p2", "p98")})
    return p.join(F.broadcast(q), "scene").select("r", "c", R.byte_stretch(F.col("red"), F.col("p2"), F.col("p98")).alias("grey"))


@query(f"with {INSIDE}, {PIXELS} select poly, scene::bigint as scene, count({NDVI}) as n, round(avg({NDVI}), 6) as mean, round(median({NDVI}), 6) as median, round(stddev_samp({NDVI}), 6) as std, round(avg(({NDVI} >= 0.2)::int), 6) as share from px join inside using (r, c) group by 1, 2 having count({NDVI}) >= 5")
def zonal_statistics(spark: SparkSession, folder: str) -> DataFrame:
    mask = G.scanline_mask(G.edges(polygon_rings(spark, folder)), side(spark, folder), side(spark, folder))
    v = pixels(spark, folder).join(mask, ["r", "c"]).select("poly", F.col("scene").cast("long").alias("scene"), R.index("NDVI").alias("v"))
    return v.groupBy("poly", "scene").agg(F.count("v").alias("n"), *[F.round(f, 6).alias(n) for n, f in (("mean", F.avg("v")), ("median", F.median("v")), ("std", F.stddev_samp("v")), ("share", F.avg((F.col("v") >= 0.2).cast("int"))))]).filter("n >= 5")


@query(f"with {RULE}, s as (select r, c from ruled where state <> 'none') select r, c from s where (select count(*) from s t where abs(t.r - s.r) + abs(t.c - s.c) = 1) < 4")
def boundary_cells(spark: SparkSession, folder: str) -> DataFrame:
    return P.boundary(P.construction(pixels(spark, folder), 1995, 1996).filter("state <> 'none'"))


@query(f"with {PIXELS} select (r // 4)::bigint as r, (c // 4)::bigint as c, round(avg((coalesce({NDVI} > 0, false))::int), 6) as share, count(*) as n from px where scene = 1996 group by 1, 2")
def coarse_fraction(spark: SparkSession, folder: str) -> DataFrame:
    done = P.coarser(pixels(spark, folder).filter("scene = 1996"), 4, F.coalesce(R.index("NDVI") > 0, F.lit(False)))
    return done.select("r", "c", F.round("share", 6).alias("share"), "n")


@query(f"with {PIXELS}, f as (select r, c, scene, coalesce(swir1 >= 0.1, false)::int as f from px), g as (select r, c, scene, min(f) over (partition by r, c order by scene desc) as f from f) select r, c, min(scene)::bigint as since from g where f = 1 group by 1, 2")
def built_since(spark: SparkSession, folder: str) -> DataFrame:
    flagged = pixels(spark, folder).withColumn("f", F.coalesce(F.col("swir1") >= 0.1, F.lit(False)))
    return P.built_since(flagged, "scene", "f").withColumn("since", F.col("since").cast("long"))


@query(f"with {PIXELS} select cls::bigint as class, count(*) as cells, count(*) * {HA} as ha, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from px where scene = 1998 group by 1")
def class_histogram(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder).filter("scene = 1998").withColumn("cls", F.col("cls").cast("long"))
    return P.class_areas(p, "cls", HA).withColumn("pct", F.round("pct", 6))


@query(f"with {PIXELS}, p as (select scene::bigint as scene, red as v from px where red > 0) select scene, p01 > 0.1 as rejected from " + _ranks("v", "p", "scene", {"p01": 0.001}))
def scene_guard(spark: SparkSession, folder: str) -> DataFrame:
    p = pixels(spark, folder).filter("red > 0").withColumn("scene", F.col("scene").cast("long"))
    return rank_percentiles(p, ["scene"], "red", {"p01": 0.001}).select("scene", (F.col("p01") > 0.1).alias("rejected"))
