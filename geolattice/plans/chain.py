"""Queries of the pixel chain: grids, masks, rules and the complete modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.functions import radiometry as R
from geolattice.functions.order_stats import rank_percentiles
from geolattice.operators import grid as GR
from geolattice.operators import pixels as P
from geolattice.operators import polygons as G
from geolattice.operators.zones import zones
from geolattice.plans.fixtures import INSIDE, PIXELS, SCENES, SIDE, pixels, polygon_rings, scenes, side
from geolattice.plans.raster import HA, MNDWI, NDBI, NDVI, RULE, _ranks, _zones_sql
from geolattice.plans.registry import query
from geolattice.session import saved, table

GRID = GR.Grid(-100.6, 20.4, -100.2, 20.8, 32, 32)
SOURCE = GR.Grid(*GR.projected_box(GRID), 32, 32)
CENTRE = "-100.6::double + (c + 0.5::double) * 0.0125::double as lon, 20.8::double - (r + 0.5::double) * 0.0125::double as lat"
CLOUDY = "bits & 1 <> 0 or bits & 62 <> 0"


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


@query(f"with {PIXELS}, k as (select distinct r, c from px), p as (select radians(20.6) as f), m as (select 0.0125 * (111412.84 * cos(f) - 93.5 * cos(3 * f) + 0.118 * cos(5 * f)) * 0.0125 * (111132.92 - 559.82 * cos(2 * f) + 1.175 * cos(4 * f) - 0.0023 * cos(6 * f)) / 10000 as ha from p) select r, c, round(lon, 9) as lon, round(lat, 9) as lat, round(ha, 6) as ha from (select r, c, {CENTRE} from k), m")
def cell_centres(spark: SparkSession, folder: str) -> DataFrame:
    lon, lat = GRID.centre(F.col("r"), F.col("c"))
    return pixels(spark, folder).select("r", "c").distinct().select("r", "c", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), F.lit(round(GRID.hectares(), 6)).alias("ha"))


@query(f"""with {PIXELS}, k as (select r, c, {CENTRE} from (select distinct r, c from px)), b as (select least(a.x, b.x, c.x, d.x) as x0, greatest(a.x, b.x, c.x, d.x) as x1, least(a.y, b.y) as y0, greatest(a.y, b.y) as y1 from (select radians(-100.6) * cos(radians(20.4)) * 6371007.181 as x, radians(20.4) * 6371007.181 as y) a,
 (select radians(-100.6) * cos(radians(20.8)) * 6371007.181 as x, radians(20.8) * 6371007.181 as y) b, (select radians(-100.2) * cos(radians(20.4)) * 6371007.181 as x) c, (select radians(-100.2) * cos(radians(20.8)) * 6371007.181 as x) d),
 l as (select r, c, floor((y1 - radians(lat) * 6371007.181) / ((y1 - y0) / 32))::bigint as sr, floor((radians(lon) * cos(radians(lat)) * 6371007.181 - x0) / ((x1 - x0) / 32))::bigint as sc from k, b),
 m as (select r, c, case when sr between 0 and 31 and sc between 0 and 31 then sr else -1 end as sr, case when sr between 0 and 31 and sc between 0 and 31 then sc else -1 end as sc from l)
 select m.r, m.c, m.sr, m.sc, round(px.red, 6) as red from m left join px on px.scene = 1996 and px.r = m.sr and px.c = m.sc""")
def reprojected(spark: SparkSession, folder: str) -> DataFrame:
    cells = GR.lookup(pixels(spark, folder).select("r", "c").distinct(), GRID, SOURCE)
    source = pixels(spark, folder).filter("scene = 1996").select("r", "c", F.round("red", 6).alias("red"))
    return GR.gather(cells, source).select("r", "c", *_long("sr", "sc"), "red")


_CODES = "case s_suppkey % 5 when 0 then 4326 when 1 then 3857 when 2 then 32601 + s_suppkey % 60 when 3 then 32701 + s_suppkey % 60 else 6372 end"


@query(f"with k as (select s_suppkey, {_CODES} as code from supplier) select s_suppkey, case when code = 4326 then 'geographic' when code = 3857 then 'mercator' when code between 32601 and 32760 then 'utm' end as kind, (case when code between 32601 and 32760 then code % 100 end)::int as zone, code between 32701 and 32760 as south from k")
def crs_codes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select("s_suppkey", GR.crs(F.expr(_CODES).cast("long")).alias("x")).select("s_suppkey", "x.*")


@query(f"with {PIXELS}, d as (select scene, round(red / 0.01) as dn from px) select scene::bigint as scene, round(sum(dn * 0.01 + case when scene < 1998 then 0 else -0.1 end), 6) as red, count(dn) as n from d group by 1")
def reflectance_by_collection(spark: SparkSession, folder: str) -> DataFrame:
    d = pixels(spark, folder).select("scene", F.round(F.col("red") / 0.01).alias("dn"))
    red = R.reflectance_without_shift(F.col("dn"), 0.01, -0.1, F.col("scene") < 1998)
    return d.groupBy(*_long("scene")).agg(F.round(F.sum(red), 6).alias("red"), F.count("dn").alias("n"))


@query(f"with {INSIDE}, {PIXELS} select scene::bigint as scene, count(*) as cells, round(sum(red), 6) as red from px join inside i on i.r = px.r and i.c = px.c and i.poly = chr(97 + px.scene % 3) group by 1")
def footprint_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Pixels inside the footprint of their own scene."""
    prints = G.scanline_mask(G.edges(polygon_rings(spark, folder)), side(spark, folder), side(spark, folder))
    p = pixels(spark, folder).withColumn("poly", F.chr(97 + F.col("scene") % 3)).join(prints, ["poly", "r", "c"], "left_semi")
    return p.groupBy(*_long("scene")).agg(F.count("*").alias("cells"), F.round(F.sum("red"), 6).alias("red"))


@query(f"with {PIXELS}, d as (select scene, case when {CLOUDY} then null else red end as red, case when {CLOUDY} then null else nir end as nir, coalesce({MNDWI} > 0, false) as water from px) select scene::bigint as scene, count(red) as clear, count(*) filter (where water) as water, count({NDVI}) filter (where water) as measured, round(avg({NDVI}) filter (where water), 6) as ndvi from d group by 1")
def clear_water(spark: SparkSession, folder: str) -> DataFrame:
    """Bands without clouds, and an index clipped to the water sheet."""
    p = pixels(spark, folder).withColumn("water", R.is_water(["green", "swir1"]))
    d = P.drop_clouds(p, R.quality_state(F.col("bits")), ["red", "nir"])
    ndvi = F.when(F.col("water"), R.index("NDVI"))
    return d.groupBy(*_long("scene")).agg(F.count("red").alias("clear"), F.count_if("water").alias("water"), F.count(ndvi).alias("measured"), F.round(F.avg(ndvi), 6).alias("ndvi"))


@query(f"""with {PIXELS}, ix as (select scene, r, c, {NDVI} as v, {MNDWI} as m, cls from px), p as (select a.v as v0, b.v as v1, a.m as m0, b.m as m1, b.cls from ix a join ix b using (r, c) where a.scene = 1995 and b.scene = 1996)
 select count(*) as cells, count(*) filter (where v0 is null or v1 is null) as without, count(*) filter (where cls = 5) as built, count(*) filter (where v0 < 0.2 and v1 < 0.2 and not coalesce(m1 > 0, false) and cls <> 5) as bare from p""")
def bare_soil_open(spark: SparkSession, folder: str) -> DataFrame:
    """Bare soil that is neither water nor built, and the cells without data, which no share rests on."""
    both = P.two_dates(pixels(spark, folder), 1995, 1996, {"ndvi": R.index("NDVI"), "mndwi": R.index("MNDWI"), "cls": F.col("cls")})
    bare = R.is_bare(F.col("ndvi_0"), F.col("ndvi_1"), F.col("mndwi_1"), F.col("cls_1"), 5)
    unknown = F.col("ndvi_0").isNull() | F.col("ndvi_1").isNull()
    return both.agg(F.count("*").alias("cells"), F.count_if(unknown).alias("without"), F.count_if(F.col("cls_1") == 5).alias("built"), F.count_if(bare).alias("bare"))


@query(f"with {PIXELS}, ix as (select scene::bigint as scene, {NDVI} as v, {NDBI} as b, {MNDWI} as m from px) select scene, count(*) filter (where v <= 0.3 and m < 0) as urbanized, count(*) filter (where v <= 0.3 and m < 0 and b >= 0.1) as by_ndbi, count(*) filter (where v is not null and m is not null) as valid from ix group by 1")
def urbanized_cells(spark: SparkSession, folder: str) -> DataFrame:
    urban = R.is_urbanized(R.index("NDVI"), R.index("MNDWI"))
    valid = R.index("NDVI").isNotNull() & R.index("MNDWI").isNotNull()
    return pixels(spark, folder).groupBy(*_long("scene")).agg(F.count_if(urban).alias("urbanized"), F.count_if(urban & (R.index("NDBI") >= 0.1)).alias("by_ndbi"), F.count_if(valid).alias("valid"))


_FOOT = "((scene_id % 5) * 2 - 3)::double as x0, ((scene_id % 3) * 2 - 3)::double as y0"


@query(f"""with {SCENES}, f as (select distinct day, {_FOOT} from sc), probe as (select i, j, (i + 0.5) * 32 / 7 as x, (j + 0.5) * 32 / 7 as y from range(7) a(i), range(7) b(j)),
 hit as (select distinct day, i, j from f, probe where x > x0 and x < x0 + 30 and y > y0 and y < y0 + 31), s as (select day, count(i) / 49.0 as share from (select distinct day from f) left join hit using (day) group by 1), best as (select max(share) as m from s)
 select day, round(share, 6) as share from s, best where share >= 0.9 or m < 0.9""")
def full_coverage_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose footprints together cover nine tenths of a lattice of probes; all days if none does."""
    foot = scenes(spark, folder).selectExpr("day", "cast((scene_id % 5) * 2 - 3 as double) as x0", "cast((scene_id % 3) * 2 - 3 as double) as y0").distinct()
    corners = F.array(*[F.struct((F.col("x0") + a).alias("x"), (F.col("y0") + b).alias("y")) for a, b in ((0, 0), (30, 0), (30, 31), (0, 31))])
    shapes = foot.select("day", F.concat_ws("/", "x0", "y0").alias("poly"), corners.alias("points"))
    return P.full_coverage(shapes, 32.0, 32.0).withColumn("share", F.round("share", 6))


_RAW = f"raw as (select year(l_shipdate)::bigint as scene, l_partkey % {SIDE} as r, l_suppkey % {SIDE} as c, (sum(l_partkey * 37) % 4000)::int as dn from lineitem group by 1, 2, 3)"


@query(f"with {_RAW}, v as (select scene, dn * 0.1::double as v from raw where dn <= 3000), n as (select scene, count(*) * {HA} as ha, round(avg(v), 6) as mean from v group by 1) select scene, ha, mean, p2, p98 from n join " + _ranks("v", "v", "scene", {"p2": 0.02, "p98": 0.98}) + " using (scene)")
def evapotranspiration(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged numbers dropped; mean, 2nd and 98th percentile and the hectares measured."""
    cells = table(spark, folder, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("scene"), (F.col("l_partkey") % side(spark, folder)).alias("r"), (F.col("l_suppkey") % side(spark, folder)).alias("c"))
    raw = cells.agg((F.sum(F.col("l_partkey") * 37) % 4000).cast("int").alias("dn"))
    v = raw.select("scene", R.unflagged(F.col("dn"), 3000, 0.1).alias("v")).filter("v is not null")
    p = rank_percentiles(v, ["scene"], "v", {"p2": 0.02, "p98": 0.98})
    return v.groupBy("scene").agg((F.count("*") * HA).alias("ha"), F.round(F.avg("v"), 6).alias("mean")).join(p, "scene").select("scene", "ha", "mean", F.round("p2", 9).alias("p2"), F.round("p98", 9).alias("p98"))


@query(f"with {PIXELS}, o as (select scene::bigint as scene, bits * 100.0 / 63 as v from px) select scene, case when v >= 90 then 'permanent' when v >= 50 then 'frequent' when v > 0 then 'seldom' else 'never' end as class, count(*) as cells, count(*) * {HA} as ha from o group by 1, 2")
def water_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    classes = R.occurrence_class(F.col("bits") * 100.0 / 63)
    return pixels(spark, folder).groupBy(*_long("scene"), classes.alias("class")).agg(F.count("*").alias("cells"), (F.count("*") * HA).alias("ha"))


@query(f"""with {RULE}, d as (select v1 - v0 as d, v0, v1 from pair where v0 is not null and v1 is not null), n as (select d, row_number() over (order by d) - 1 as k, count(*) over () as n from d),
 p as (select max(case when k = least(n - 1, floor(0.02 * n)) then d end) as lo, max(case when k = least(n - 1, floor(0.98 * n)) then d end) as hi, max(case when k = n // 2 then d end) as mid from n)
 select round(greatest(0.2, abs(lo), abs(hi)), 9) as limit_, count(*) filter (where d <= -0.1) * {HA} as down_ha, count(*) filter (where d > -0.1 and d < 0.1) * {HA} as stable_ha, count(*) filter (where d >= 0.1) * {HA} as up_ha, round(avg(d), 6) as mean, round(max(mid), 9) as upper_median, abs(max(mid)) >= 0.05 as greening from d, p group by lo, hi""")
def change_report(spark: SparkSession, folder: str) -> DataFrame:
    """The change mode as a whole: the symmetric limit of its legend, hectares by class, mean and the warning that green moved everywhere."""
    both = P.two_dates(pixels(spark, folder), 1995, 1996, {"ndvi": R.index("NDVI")}).select((F.col("ndvi_1") - F.col("ndvi_0")).alias("d")).filter("d is not null")
    return P.change_report(both, "d", 0.1, HA, 0.05)


_STATES = _zones_sql("abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1", 1).rsplit("select zone, count(*)", 1)[0]


@query(f"""{_STATES} , sized as (select zone, count(*) as n from z group by 1), kind as (select own.*, z.zone, sized.n, ruled.state from own join z on own.id = z.x join sized using (zone) join ruled using (r, c)),
 f as (select count(*) as comparable, count(*) filter (where state <> 'none') as raw from ruled) select f.comparable, f.raw, count(*) filter (where n >= 2) as kept_cells, count(distinct case when n >= 2 then zone end) as zones, round(max(n) * {HA}, 6) as largest_ha, month(date '1995-08-15') between 7 and 10 and month(date '1996-11-15') between 7 and 10 as painted from kind, f group by 1, 2""")
def construction_report(spark: SparkSession, folder: str) -> DataFrame:
    """The construction mode as a whole: raw and comparable cells, zones over the least size, and whether their dates let them be painted."""
    cells = saved(P.construction(pixels(spark, folder), 1995, 1996).select("r", "c", "state"), "states")
    every = zones(cells.filter("state <> 'none'"), saved, cell_ha=HA)
    counts = cells.agg(F.count("*").alias("comparable"), F.count_if(F.col("state") != "none").alias("raw"))
    kept = every.agg(F.coalesce(F.sum(F.when(F.col("cells") >= 2, F.col("cells"))), F.lit(0)).alias("kept_cells"), F.count_if(F.col("cells") >= 2).alias("zones"), F.round(F.max("ha"), 6).alias("largest_ha"))
    painted = R.reliable_pair(F.lit("1995-08-15").cast("date"), F.lit("1996-11-15").cast("date"))
    return counts.join(F.broadcast(kept)).withColumn("painted", painted)


_BANDS = ("red", "green", "nir")


@query(f"with {PIXELS}, s as (select * from px where scene = 1996 and red is not null and green is not null and nir is not null), " + ", ".join(f"q_{b} as (select lo as lo_{b}, hi as hi_{b} from " + _ranks(b, "px", "scene", {"lo": 0.02, "hi": 0.98}) + " where scene = 1996)" for b in _BANDS) + " select r, c, " + ", ".join(f"floor(pow(least(greatest(({b} - lo_{b}) / (hi_{b} - lo_{b}), 0), 1), 0.7) * 255 + 0.5)::bigint as {b}" for b in _BANDS) + " from s, " + ", ".join(f"q_{b}" for b in _BANDS))
def true_colour(spark: SparkSession, folder: str) -> DataFrame:
    """Three bands stretched between their percentiles, with gamma 0.7."""
    bands = list(_BANDS)
    p = pixels(spark, folder).filter("scene = 1996")
    return P.true_colour(p, bands, (0.02, 0.98), 0.7).select("r", "c", *bands)


@query(f"with {PIXELS}, t as (select scene::bigint as scene, red * 100 - 5 - 273.15 as v from px where red is not null), n as (select scene, round(avg(v), 6) as mean from t group by 1) select scene, mean, p2, p98 from n join " + _ranks("v", "t", "scene", {"p2": 0.02, "p98": 0.98}) + " using (scene)")
def heat_report(spark: SparkSession, folder: str) -> DataFrame:
    t = pixels(spark, folder).filter("red is not null").select(*_long("scene"), R.celsius(F.col("red") * 100 - 5).alias("v"))
    p = rank_percentiles(t, ["scene"], "v", {"p2": 0.02, "p98": 0.98})
    return t.groupBy("scene").agg(F.round(F.avg("v"), 6).alias("mean")).join(p, "scene").select("scene", "mean", F.round("p2", 9).alias("p2"), F.round("p98", 9).alias("p98"))


_MEASURED = f"{INSIDE}, {PIXELS}, k as (select i.poly, px.* from px join inside i using (r, c))"


@query(f"with {_MEASURED}, s as (select poly, cls::bigint as class, count(*) as n from k where scene = 1996 group by 1, 2) select poly, class, n * {HA} as ha, round(100.0 * n / sum(n) over (partition by poly), 6) as pct from s")
def measure_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Mode cover of the measuring job: hectares and share of each class in each polygon."""
    k = pixels(spark, folder).filter("scene = 1996").join(G.scanline_mask(G.edges(polygon_rings(spark, folder)), side(spark, folder), side(spark, folder)), ["r", "c"])
    s = k.groupBy("poly", F.col("cls").cast("long").alias("class")).agg(F.count("*").alias("n"))
    return s.select("poly", "class", (F.col("n") * HA).alias("ha"), F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("poly")), 6).alias("pct"))


@query(f"""with {_MEASURED}, b as (select poly, r, c, {NDVI} as v, {MNDWI} as m, cls, scene from k), p as (select a.poly, a.v as v0, b.v as v1, b.m as m1, b.cls from b a join b using (poly, r, c) where a.scene = 1995 and b.scene = 1996)
 select poly, count(*) * {HA} as area_ha, count(*) filter (where v0 is null or v1 is null) * {HA} as without_ha, count(*) filter (where v0 < 0.2 and v1 < 0.2 and not coalesce(m1 > 0, false) and cls <> 5) * {HA} as bare_ha,
 round(100.0 * count(*) filter (where v0 < 0.2 and v1 < 0.2 and not coalesce(m1 > 0, false) and cls <> 5) / nullif(count(*) filter (where v0 is not null and v1 is not null), 0), 6) as pct from p group by 1""")
def measure_bare(spark: SparkSession, folder: str) -> DataFrame:
    """Mode bare soil of the measuring job; the share rests on the cells with data."""
    both = P.two_dates(pixels(spark, folder), 1995, 1996, {"ndvi": R.index("NDVI"), "mndwi": R.index("MNDWI"), "cls": F.col("cls")})
    k = both.join(G.scanline_mask(G.edges(polygon_rings(spark, folder)), side(spark, folder), side(spark, folder)), ["r", "c"])
    bare = F.count_if(R.is_bare(F.col("ndvi_0"), F.col("ndvi_1"), F.col("mndwi_1"), F.col("cls_1"), 5))
    unknown = F.count_if(F.col("ndvi_0").isNull() | F.col("ndvi_1").isNull())
    return k.groupBy("poly").agg((F.count("*") * HA).alias("area_ha"), (unknown * HA).alias("without_ha"), (bare * HA).alias("bare_ha"), F.round(100.0 * bare / F.nullif(F.count("*") - unknown, F.lit(0)), 6).alias("pct"))


@query(f"with {INSIDE}, {RULE} select poly, count(*) as comparable, count(*) filter (where state = 'construction') * {HA} as built_ha, count(*) filter (where state = 'vegetation_loss') * {HA} as lost_ha from ruled join inside using (r, c) group by 1")
def measure_construction(spark: SparkSession, folder: str) -> DataFrame:
    """Mode construction of the measuring job."""
    k = P.construction(pixels(spark, folder), 1995, 1996).join(G.scanline_mask(G.edges(polygon_rings(spark, folder)), side(spark, folder), side(spark, folder)), ["r", "c"])
    return k.groupBy("poly").agg(F.count("*").alias("comparable"), (F.count_if(F.col("state") == "construction") * HA).alias("built_ha"), (F.count_if(F.col("state") == "vegetation_loss") * HA).alias("lost_ha"))


@query(f"with {_MEASURED} select poly, count(red) as n, round(avg(red * 100 - 5 - 273.15), 6) as celsius, round(avg({NDVI}), 6) as ndvi from k where scene = 1996 group by 1")
def measure_heat_and_index(spark: SparkSession, folder: str) -> DataFrame:
    """Modes heat and index of the measuring job: means of the valid cells of each polygon."""
    k = pixels(spark, folder).filter("scene = 1996").join(G.scanline_mask(G.edges(polygon_rings(spark, folder)), side(spark, folder), side(spark, folder)), ["r", "c"])
    return k.groupBy("poly").agg(F.count("red").alias("n"), F.round(F.avg(R.celsius(F.col("red") * 100 - 5)), 6).alias("celsius"), F.round(F.avg(R.index("NDVI")), 6).alias("ndvi"))


@query(f"with {PIXELS}, a as (select r, c, red, abs(scene - 1996) as d, scene from px where red > 0) select r, c, arg_min(scene, d * 100 + (scene < 1996)::int)::bigint as src, round(arg_min(red, d * 100 + (scene < 1996)::int), 6) as red from a group by 1, 2")
def background_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Each cell from the scene nearest to a date, the later of equals; a scene counts where its red is positive."""
    near = F.struct(F.abs(F.col("scene") - 1996), -F.col("scene"))
    done = P.first_valid(pixels(spark, folder).filter("red > 0"), ["red"], near)
    return done.select("r", "c", *_long("src"), F.round("red", 6).alias("red"))


@query(f"with {PIXELS}, v as (select r, c, {NDVI} as v, scene from px) select r, c, round(median(v) filter (where scene % 2 = 1), 6) as odd, round(median(v) filter (where scene % 2 = 0), 6) as even, round(median(v) filter (where scene >= 1998), 6) as late from v group by 1, 2")
def subset_composites(spark: SparkSession, folder: str) -> DataFrame:
    v = R.index("NDVI")
    parts = {"odd": F.col("scene") % 2 == 1, "even": F.col("scene") % 2 == 0, "late": F.col("scene") >= 1998}
    return pixels(spark, folder).groupBy("r", "c").agg(*[F.round(F.median(F.when(w, v)), 6).alias(n) for n, w in parts.items()])


@query(f"with {PIXELS}, g as (select r // 4 as gr, c // 4 as gc, {NDVI} as v from px where scene = 1996) select gr::bigint as gr, gc::bigint as gc, count(v) as n, '[[' || (gc * 4) || ',' || (gr * 4) || '],[' || (gc * 4 + 4) || ',' || (gr * 4) || '],[' || (gc * 4 + 4) || ',' || (gr * 4 + 4) || '],[' || (gc * 4) || ',' || (gr * 4 + 4) || '],[' || (gc * 4) || ',' || (gr * 4) || ']]' as ring from g group by 1, 2, 4")
def cell_squares(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of cells as closed squares of five points, in JSON."""
    g = pixels(spark, folder).filter("scene = 1996").groupBy(F.floor(F.col("r") / 4).alias("gr"), F.floor(F.col("c") / 4).alias("gc")).agg(F.count(R.index("NDVI")).alias("n"))
    return g.select("gr", "gc", "n", P.square(F.col("gr") * 4, F.col("gc") * 4, 4).alias("ring"))
