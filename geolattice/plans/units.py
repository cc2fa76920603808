"""Queries on units: overlaps, lookups, intervals, runoff by basin, census filling and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.functions import radiometry as R
from geolattice.operators import pixels as P
from geolattice.operators import polygons as G
from geolattice.operators import quadtree as Q
from geolattice.operators import units as U
from geolattice.plans.fixtures import EDGES, INSIDE, SCENES, pixels, polygon_rings, scenes, side
from geolattice.plans.raster import RULE
from geolattice.plans.registry import query
from geolattice.session import saved, table



#: Sectors are blocks of 8 by 8 cells.
SECTOR = "cast(floor(r / 8) * 1000 + floor(c / 8) as bigint)"


def _mask(spark: SparkSession, folder: str) -> DataFrame:
    return G.scanline_mask(G.edges(polygon_rings(spark, folder)), side(spark, folder), side(spark, folder))


@query("with s as (select s_suppkey as id, s_nationkey from supplier), n as (select n_nationkey, n_name from nation where n_nationkey % 4 <> 1) select id, coalesce(n_name, 'not reviewed') as name from s left join n on s_nationkey = n_nationkey")
def lookup_with_default(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, folder, "nation").filter("n_nationkey % 4 <> 1").select("n_nationkey", F.col("n_name").alias("name"))
    return U.with_default(s, n, "n_nationkey", "name", "not reviewed").select("id", "name")


@query("with a as (select c_nationkey as unit, count(*) as customers from customer where c_acctbal > 9000 group by 1), b as (select s_nationkey as unit, count(*) as suppliers from supplier where s_acctbal > 8000 group by 1) select coalesce(a.unit, b.unit)::bigint as unit, coalesce(customers, 0) as customers, coalesce(suppliers, 0) as suppliers from a full join b on a.unit = b.unit")
def merged_summaries(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").cast("long").alias("unit")).agg(F.count("*").alias("customers"))
    b = table(spark, folder, "supplier").filter("s_acctbal > 8000").groupBy(F.col("s_nationkey").cast("long").alias("unit")).agg(F.count("*").alias("suppliers"))
    return U.merge_summaries([a, b], "unit")


@query(f"with {SCENES}, a as (select distinct tile, day from sc where cloud < 30), b as (select distinct tile, day from sc where cloud < 20) select a.tile, a.day, min(b.day) as second from a left join b on a.tile = b.tile and date_diff('day', a.day, b.day) between 10 and 75 group by 1, 2")
def interval_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The second date of a pair: the first one 10 to 75 days later."""
    s = scenes(spark, folder)
    return U.first_in_interval(s.filter("cloud < 30").select("tile", "day").distinct(), s.filter("cloud < 20").select("tile", "day"), ["tile"], 10, 75)


@query(f"with {SCENES}, a as (select distinct day from sc where tile = 0 and cloud < 40), b as (select distinct day from sc where tile = 1 and cloud < 40) select max(day) as day, count(*) as days from a join b using (day)")
def common_date(spark: SparkSession, folder: str) -> DataFrame:
    """The latest day of one collection that another has too."""
    s = scenes(spark, folder).filter("cloud < 40")
    both = s.filter("tile = 0").select("day").distinct().join(s.filter("tile = 1").select("day"), "day", "left_semi")
    return both.agg(F.max("day").alias("day"), F.count("*").alias("days"))


_BASIN = f"""{EDGES}, basin as (select p.poly, p.cn, p.km2, p.declared from (values ('a', 78.0::double, 4.0::double, 5.0::double), ('b', 85.0, 9.5, 10.0), ('c', null, 3.0, 3.0), ('d', 70.0, 0.0, 2.0), ('e', 66.0, 2.0, 2.5)) p(poly, cn, km2, declared)),
 kept as (select poly, cn, km2, declared from basin where cn is not null and km2 > 0), zone as (select s_suppkey as id, (s_suppkey * 37 % 320) / 10.0 + 0.013 as x, (s_suppkey * 91 % 320) / 10.0 + 0.017 as y, 1.0 + s_suppkey % 7 as ha from supplier),
 hit as (select id, poly from zone, edges where (y0 > y) <> (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0 group by 1, 2 having count(*) % 2 = 1), own as (select id, min(poly) as poly from hit join kept using (poly) group by 1),
 new as (select k.poly, coalesce(sum(ha), 0) as ha from kept k left join own using (poly) left join zone using (id) group by 1), mixed as (select poly, cn, cn + (98 - cn) * least(1.0, ha / (km2 * 100)) as cn2, km2, ha, declared from kept join new using (poly)),
 depth as (select *, case when 60 <= 0.2 * (25400 / cn - 254) then 0 else pow(60 - 0.2 * (25400 / cn - 254), 2) / (60 + 0.8 * (25400 / cn - 254)) end * km2 * 1000 as v0, case when 60 <= 0.2 * (25400 / cn2 - 254) then 0 else pow(60 - 0.2 * (25400 / cn2 - 254), 2) / (60 + 0.8 * (25400 / cn2 - 254)) end * km2 * 1000 as v1 from mixed)"""
BASINS = [("a", 78.0, 4.0, 5.0), ("b", 85.0, 9.5, 10.0), ("c", None, 3.0, 3.0), ("d", 70.0, 0.0, 2.0), ("e", 66.0, 2.0, 2.5)]


def _basins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASINS, "poly string, cn double, km2 double, declared double")


def _runoff(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    found = table(spark, folder, "supplier").selectExpr("s_suppkey as id", "(s_suppkey * 37 % 320) / 10.0D + 0.013D as x", "(s_suppkey * 91 % 320) / 10.0D + 0.017D as y", "1.0D + s_suppkey % 7 as ha")
    kept = R.usable_basins(_basins(spark))
    return R.runoff_by_basin(kept, G.first_containing(found, G.edges(polygon_rings(spark, folder).join(kept.select("poly"), "poly", "left_semi"))).join(found.select("id", "ha"), "id"), F.lit(60.0))


@query(f"with {_BASIN} select poly, round(ha, 6) as ha, round(cn2, 9) as cn_new, round(v0, 4) as before_m3, round(v1, 4) as after_m3, km2 / declared < 0.9 as partial from depth order by v1 desc limit 15")
def runoff_by_basin(spark: SparkSession, folder: str) -> DataFrame:
    """New built zones assigned to the first basin that holds them, curve numbers mixed, volumes before and after; the report shows 15."""
    rows, _ = _runoff(spark, folder)
    rows = rows.select("poly", F.round("ha", 6).alias("ha"), F.round("cn_new", 9).alias("cn_new"), F.round("v0", 4).alias("before_m3"), F.round("v1", 4).alias("after_m3"), (F.col("km2") / F.col("declared") < 0.9).alias("partial"))
    return rows.orderBy(F.desc("after_m3")).limit(15)


@query(f"with {_BASIN} select round(sum(v0), 4) as before_m3, round(sum(v1), 4) as after_m3, round(sum(ha), 6) as ha, count(*) filter (where ha > 0) as receptors, round(sum(case when ha > 0 then v1 else 0 end), 4) as receptors_m3, count(*) filter (where km2 / declared < 0.9) as partial, (select count(*) from zone) - (select count(*) from own) as outside, (select count(*) from basin) - count(*) as discarded from depth")
def runoff_totals(spark: SparkSession, folder: str) -> DataFrame:
    rows, outside = _runoff(spark, folder)
    new = F.col("ha") > 0
    totals = rows.agg(F.round(F.sum("v0"), 4).alias("before_m3"), F.round(F.sum("v1"), 4).alias("after_m3"), F.round(F.sum("ha"), 6).alias("ha"), F.count_if(new).alias("receptors"), F.round(F.sum(F.when(new, F.col("v1")).otherwise(0.0)), 4).alias("receptors_m3"), F.count_if(F.col("km2") / F.col("declared") < 0.9).alias("partial"))
    return totals.join(F.broadcast(outside)).join(F.broadcast(R.discarded_basins(_basins(spark)).agg(F.count("*").alias("discarded"))))


@query("with b as (select p_partkey as block, p_size as unit, p_partkey % 13 + 1 as area, case when p_partkey % 5 <> 0 then p_partkey % 40 end as v from part), t as (select p_size as unit, sum(p_partkey % 40) + 7 as total from part group by 1), k as (select *, coalesce(sum(v) over (partition by unit), 0) as known, sum(case when v is null then area end) over (partition by unit) as hidden from b) select block, round(coalesce(v::double, greatest(total - known, 0) * area::double / hidden), 6) as v from k join t using (unit)")
def census_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Withheld block counts filled from the total of their unit, by area."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("block"), F.col("p_size").alias("unit"), (F.col("p_partkey") % 13 + 1).alias("area"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 40).alias("v"))
    totals = table(spark, folder, "part").groupBy(F.col("p_size").alias("unit")).agg((F.sum(F.col("p_partkey") % 40) + 7).alias("total"))
    return U.fill_suppressed(p, totals, "unit", "v", "area", "total").select("block", F.round("v", 6).alias("v"))


@query("with u as (select p_brand as dev, (p_partkey % 37) / 10.0 as ha from part), s as (select dev, ha, sum(case when ha < 2 then ha end) over (partition by dev) as small from u) select dev, round(ha, 6) as ha, 1::bigint as units from s where ha >= 2 union all select dev, round(sum(ha), 6), count(*) from s where ha < 2 and small >= 2 group by 1")
def pooled_units(spark: SparkSession, folder: str) -> DataFrame:
    u = table(spark, folder, "part").select(F.col("p_brand").alias("dev"), ((F.col("p_partkey") % 37) / F.lit(10.0)).alias("ha"))
    return U.pooled(u, "dev", "ha", 2.0).withColumn("ha", F.round("ha", 6))


_PLACES = "p as (select c_custkey as id, (c_custkey * 7919 % 10007) / 10.0 as x, (c_custkey * 104729 % 10009) / 10.0 as y, c_custkey % 9 as pop from customer), q as (select s_suppkey as place, (s_suppkey * 7907 % 10007) / 10.0 as px, (s_suppkey * 6101 % 10009) / 10.0 as py from supplier)"


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr("c_custkey as id", "(c_custkey * 7919 % 10007) / 10.0D as x", "(c_custkey * 104729 % 10009) / 10.0D as y", "c_custkey % 9 as pop")


@query(f"with {_PLACES} select place, count(id) as n, coalesce(sum(pop), 0)::bigint as total from q left join p on sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 60 group by 1")
def people_in_reach(spark: SparkSession, folder: str) -> DataFrame:
    places = table(spark, folder, "supplier").selectExpr("s_suppkey as place", "(s_suppkey * 7907 % 10007) / 10.0D as px", "(s_suppkey * 6101 % 10009) / 10.0D as py")
    return U.within_radius(_points(spark, folder), places, 60.0, "pop")


@query(f"""with {_PLACES}, l as (select place as line, px as x0, py as y0, px + place % 11 * 5.0 - 25 as x1, py + place % 7 * 6.0 - 18 as y1 from q), t as (select id, line, x, y, x0, y0, x1, y1, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) as n from p, l),
 u as (select *, case when n = 0 then 0 else least(greatest(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n, 0), 1) end as f from t), d as (select id, line, sqrt(pow(x - (x0 + f * (x1 - x0)), 2) + pow(y - (y0 + f * (y1 - y0)), 2)) as d from u), k as (select *, row_number() over (partition by id order by round(d, 9), line) as k from d) select id, line, round(d, 6) as d from k where k = 1""")
def nearest_line(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "supplier").selectExpr("s_suppkey as line", "(s_suppkey * 7907 % 10007) / 10.0D as x0", "(s_suppkey * 6101 % 10009) / 10.0D as y0").selectExpr("line", "x0", "y0", "x0 + line % 11 * 5.0D - 25 as x1", "y0 + line % 7 * 6.0D - 18 as y1")
    return Q.nearest_line(_points(spark, folder), lines, saved).withColumn("d", F.round("d", 6))


_BUILT = "g as (select l_partkey % 40 as r, l_suppkey % 40 as c, year(l_shipdate) as y, sum(l_quantity)::double * 40 as gain from lineitem group by 1, 2, 3), b as (select r, c, sum(case when y <= 1996 then gain else 0 end) as b0, sum(gain) as b1 from g group by 1, 2)"


def _built(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy((F.col("l_partkey") % 40).alias("r"), (F.col("l_suppkey") % 40).alias("c"), F.year("l_shipdate").alias("y")).agg((F.sum("l_quantity").cast("double") * 40).alias("gain"))


@query(f"with {_BUILT}, k as (select r, c, case when b1 - b0 >= 1000 then case when b0 / 10000 < 0.2 then 'expansion' else 'densification' end end as class, b1 - b0 as m2 from b), m as (select r, c, arg_max(y, gain * 10000 - y)::bigint as period from g group by 1, 2) select class, period, count(*) as cells, round(sum(m2), 4) as m2 from k join m using (r, c) where class is not null group by 1, 2")
def growth_fronts(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that grew, by what they were and by the period of their largest gain."""
    gains = _built(spark, folder)
    b = gains.groupBy("r", "c").agg(F.sum(F.when(F.col("y") <= 1996, F.col("gain")).otherwise(0.0)).alias("b0"), F.sum("gain").alias("b1"), F.max_by("y", F.struct("gain", -F.col("y"))).cast("long").alias("period"))
    b = b.withColumn("class", U.growth_class(F.col("b0"), F.col("b1"))).filter("class is not null")
    return b.groupBy("class", "period").agg(F.count("*").alias("cells"), F.round(F.sum(F.col("b1") - F.col("b0")), 4).alias("m2"))


@query(f"with {_BUILT}, f as (select r, c, b0, b1, ((r * 7 + c * 3) % 11) / 10.0 as share from b) select round(sum(case when b0 / 10000 < 0.2 then (b1 - b0) * share else 0 end), 4) as expansion, round(sum(case when b0 / 10000 >= 0.2 then (b1 - b0) * share else 0 end), 4) as consolidation, round(sum(b1 * share), 4) as total, count(*) filter (where b0 >= 4000 and b1 >= 4000) as old_city, round(sum(case when b0 >= 4000 then (b1 - b0) / 5 else 0 end) / count(*) filter (where b0 >= 4000), 6) as infill from f")
def growth_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Gains weighted by the share of a cell inside, split by what the cell was; the old city (built on both dates) and its infill a year and hectare."""
    b = _built(spark, folder).groupBy("r", "c").agg(F.sum(F.when(F.col("y") <= 1996, F.col("gain")).otherwise(0.0)).alias("b0"), F.sum("gain").alias("b1"))
    share, sparse, old = ((F.col("r") * 7 + F.col("c") * 3) % 11) / F.lit(10.0), F.col("b0") / 10000 < 0.2, F.col("b0") >= 4000
    gain = F.col("b1") - F.col("b0")
    return b.agg(
        F.round(F.sum(F.when(sparse, gain * share).otherwise(0.0)), 4).alias("expansion"), F.round(F.sum(F.when(~sparse, gain * share).otherwise(0.0)), 4).alias("consolidation"), F.round(F.sum(F.col("b1") * share), 4).alias("total"),
        F.count_if(old & (F.col("b1") >= 4000)).alias("old_city"), F.round(F.sum(F.when(old, gain / 5).otherwise(0.0)) / F.count_if(old), 6).alias("infill"),
    )


@query(f"with {INSIDE}, {RULE}, own as (select r, c from ruled where state <> 'none'), k as (select poly, count(*) as area from inside group by 1), h as (select poly, count(*) as hit from inside join own using (r, c) group by 1) select poly, area, coalesce(hit, 0) as hit, round(coalesce(hit, 0) / area, 6) as share, round((select count(*) from own) / (select count(*) from ruled), 6) as base from k left join h using (poly)")
def concordance(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each zone that changed, beside the share of all comparable cells."""
    ruled = P.construction(pixels(spark, folder), 1995, 1996)
    base = ruled.agg(F.round(F.avg((F.col("state") != "none").cast("double")), 6).alias("base"))
    hit = _mask(spark, folder).join(ruled.select("r", "c", "state"), ["r", "c"], "left").groupBy("poly").agg(F.count("*").alias("area"), F.count_if(F.coalesce(F.col("state") != "none", F.lit(False))).alias("hit"))
    return hit.join(F.broadcast(base)).withColumn("share", F.round(F.col("hit") / F.col("area"), 6))


_LISTED = {"3": "heading", "7": "not citable", "12": "band"}


@query("select s_suppkey, case s_suppkey when 3 then 'heading' when 7 then 'not citable' when 12 then 'band' else case when s_acctbal / 10000 >= 0.9 then 'whole' else 'part' end end as class, coalesce(case when s_suppkey % 3 = 0 then s_name end, case when s_suppkey % 3 = 1 then s_suppkey::varchar end, 'Unit ' || s_suppkey) as label from supplier")
def citation_classes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("s_suppkey")
    label = F.coalesce(F.when(key % 3 == 0, F.col("s_name")), F.when(key % 3 == 1, key.cast("string")), F.concat(F.lit("Unit "), key))
    return table(spark, folder, "supplier").select("s_suppkey", U.citation(key.cast("string"), F.col("s_acctbal") / 10000, _LISTED).alias("class"), label.alias("label"))


@query("with n as (select c_custkey, c_mktsegment || case c_custkey % 4 when 0 then ' SECCION II' when 1 then ' 3' when 2 then ' b_north' else '' end as name from customer), h as (select c_custkey, regexp_replace(upper(trim(split_part(name, '_', 1))), '\\s+(SECCION|SECTION|ETAPA|STAGE)?\\s*([IVX]+|[0-9]+|[A-Z])$', '') as s from n) select c_custkey, case s when 'HOUSEHOLD' then 'HOMES' else s end as dev from h")
def development_names(spark: SparkSession, folder: str) -> DataFrame:
    more = F.element_at(F.array(*[F.lit(x) for x in (" SECCION II", " 3", " b_north", "")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", U.plain_name(F.concat("c_mktsegment", more), {"HOUSEHOLD": "HOMES"}).alias("dev"))


@query("with s as (select c_custkey as id, s_suppkey as s, row_number() over (partition by c_custkey order by s_suppkey) as k from customer join supplier on c_nationkey = s_nationkey and s_suppkey % 3 = c_custkey % 3) select c_custkey as id, coalesce(s, -1)::bigint as unit from customer left join (select * from s where k = 1) t on c_custkey = t.id")
def first_unit(spark: SparkSession, folder: str) -> DataFrame:
    """A left join to zones that may hold a point twice: the first zone is taken, and points outside keep their row."""
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 3).alias("m"))
    s = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 3).alias("m")).agg(F.min("s_suppkey").alias("unit"))
    return c.join(s, ["n", "m"], "left").select("id", F.coalesce("unit", F.lit(-1)).cast("long").alias("unit"))


@query("with z as (select n_nationkey as sector, s.scenario from nation, (values ('low'), ('model'), ('high')) s(scenario)), v as (select c_nationkey as sector, count(*) as n from customer group by 1) select sector::bigint as sector, scenario, round(n * case scenario when 'low' then 0.8::double when 'model' then 1.0 else 1.25 end, 6) as value from z join v using (sector)")
def scenario_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every sector under every scenario."""
    v = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("long").alias("sector")).agg(F.count("*").alias("n"))
    factors = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(f).alias("f")) for s, f in (("low", 0.8), ("model", 1.0), ("high", 1.25))])
    return v.select("sector", "n", F.explode(factors).alias("x")).select("sector", "x.scenario", F.round(F.col("n") * F.col("x.f"), 6).alias("value"))


@query("with t as (select s_suppkey as id, case when s_suppkey % 6 = 0 then 'park' when s_suppkey % 6 = 1 then 'pitch' when s_suppkey % 6 = 2 then 'wood' end as leisure, case when s_suppkey % 5 = 0 then 'private' end as access, case when s_suppkey % 7 = 0 then 'water' end as natural_ from supplier) select id, case when access = 'private' then 'private' when natural_ = 'water' then 'public_blue' when leisure = 'park' then 'public_green' when leisure = 'pitch' then 'pitch' when leisure = 'wood' then 'natural_area' else 'context' end as class from t")
def tag_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Map features by the first rule that their tags meet."""
    k = F.col("s_suppkey")
    tags = F.map_filter(F.create_map(F.lit("leisure"), F.when(k % 6 == 0, "park").when(k % 6 == 1, "pitch").when(k % 6 == 2, "wood"), F.lit("access"), F.when(k % 5 == 0, "private"), F.lit("natural"), F.when(k % 7 == 0, "water")), lambda _, v: v.isNotNull())
    return table(spark, folder, "supplier").select(k.alias("id"), R.tag_class(tags).alias("class"))


@query("with a as (select c_nationkey as unit, count(*) as n from customer group by 1 order by n desc, unit limit 8), b as (select s_nationkey as unit, count(*) as n from supplier group by 1 order by n desc, unit limit 8) select 'both' as place, count(*) as n from a join b using (unit) union all select 'any', count(*) from (select unit from a union select unit from b) union all select 'first', count(*) from (select unit from a except select unit from b)")
def id_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Intersection, union and difference of two sets of the eight largest units."""
    top = lambda t, c: table(spark, folder, t).groupBy(F.col(c).alias("unit")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").limit(8).select("unit")
    a, b = top("customer", "c_nationkey"), top("supplier", "s_nationkey")
    sets = {"both": a.intersect(b), "any": a.union(b).distinct(), "first": a.subtract(b)}
    out = [s.agg(F.count("*").alias("n")).select(F.lit(k).alias("place"), "n") for k, s in sets.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("select c_mktsegment as value, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from customer group by 1")
def value_counts(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("value", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("with s as (select s_suppkey as pitch, s_nationkey as n, (s_suppkey * 37 % 100) / 10.0 as d from supplier) select pitch, case when min(d) over (partition by n) <= 0.3 and d <= 3 then 'public' else 'to_confirm' end as class from s")
def attached_pitches(spark: SparkSession, folder: str) -> DataFrame:
    """Loose pitches near a park that has one close by are public, others to be confirmed."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("pitch"), F.col("s_nationkey").alias("n"), ((F.col("s_suppkey") * 37 % 100) / F.lit(10.0)).alias("d"))
    near = F.min("d").over(Window.partitionBy("n")) <= 0.3
    return s.select("pitch", F.when(near & (F.col("d") <= 3), "public").otherwise("to_confirm").alias("class"))
