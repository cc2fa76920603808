"""Queries on series: heat by sector, seasons, candidates, stacks, ageing and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.functions import radiometry as R
from geolattice.functions.order_stats import spearman, terciles
from geolattice.operators import dates as D
from geolattice.operators import pixels as P
from geolattice.operators import seasons as S
from geolattice.operators import territory as T
from geolattice.operators.zones import label
from geolattice.plans.fixtures import PIXELS, SCENES, SIDE, pixels, scenes, side
from geolattice.plans.raster import HA, NDVI, _zones_sql
from geolattice.plans.registry import query
from geolattice.plans.units import SECTOR
from geolattice.session import saved, table

_HEAT = f"{PIXELS}, heat as (select scene::bigint as scene, r, c, {SECTOR} as sector, red * 100 as v from px where red is not null), yearly as (select sector, scene, median(v) as m from heat group by 1, 2)"


def _heat(spark: SparkSession, folder: str) -> DataFrame:
    return pixels(spark, folder).filter("red is not null").select(F.col("scene").cast("long").alias("scene"), "r", "c", F.expr(SECTOR).alias("sector"), (F.col("red") * 100).alias("v"))


@query(f"with {_HEAT}, k as (select r, c, sector, median(v) as v, count(*) as n_obs from heat group by 1, 2, 3) select sector, round(median(v), 6) as median, count(*) as cells, round(avg(n_obs), 6) as n_obs from k group by 1")
def heat_by_sector(spark: SparkSession, folder: str) -> DataFrame:
    """Median over time of each cell, then over the cells of each sector."""
    cells = _heat(spark, folder).groupBy("r", "c", "sector").agg(F.median("v").alias("v"), F.count("*").alias("n_obs"))
    return cells.groupBy("sector").agg(F.round(F.median("v"), 6).alias("median"), F.count("*").alias("cells"), F.round(F.avg("n_obs"), 6).alias("n_obs"))


@query(f"with {_HEAT} select scene, round(median(v) filter (where sector in (5, 6, 9, 10)) - median(v) filter (where sector not in (5, 6, 9, 10)), 6) as gap from heat group by 1")
def urban_rural_gap(spark: SparkSession, folder: str) -> DataFrame:
    rural = ~F.col("sector").isin(5, 6, 9, 10)
    return S.minus_reference(_heat(spark, folder), ["scene"], "v", rural).withColumn("gap", F.round("gap", 6))


@query(f"with {_HEAT}, u as (select scene, median(v) filter (where sector not in (5, 6, 9, 10)) as rural from heat group by 1), a as (select sector, scene, m - rural as v from yearly join u using (scene)) select sector, count(v) as years, count(*) filter (where v >= 2) as over, count(*) filter (where v >= 2) >= ceil(2.0 / 3 * count(v) - 0.000000001) and count(v) >= 3 as island from a group by 1")
def heat_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Sectors that are 2 degrees or more above the countryside in two of three years."""
    heat = _heat(spark, folder)
    rural = heat.groupBy("scene").agg(F.median(F.when(~F.col("sector").isin(5, 6, 9, 10), F.col("v"))).alias("rural"))
    yearly = heat.groupBy("sector", "scene").agg(F.median("v").alias("m")).join(F.broadcast(rural), "scene").select("sector", "scene", (F.col("m") - F.col("rural")).alias("v"))
    return S.persistent(yearly, "sector", "v", 2.0)


@query(f"""with {_HEAT}, s as (select sector, median(v) as m, avg((c + r) % 7) as built, median(v) filter (where scene % 2 = 1) as odd, median(v) filter (where scene % 2 = 0) as even from heat group by 1), e as (select quantile_cont(built, 1.0 / 3) as a, quantile_cont(built, 2.0 / 3) as b from s),
 t as (select s.*, case when built <= a then 1 when built <= b then 2 else 3 end as tercile from s, e), o as (select sector, tercile, m - median(m) over w as anomaly, odd - median(odd) over w as x, even - median(even) over w as y from t window w as (partition by tercile)) select sector, tercile::bigint as tercile, round(anomaly, 6) as anomaly, anomaly >= 1 as hotter from o""")
def heat_against_kind(spark: SparkSession, folder: str) -> DataFrame:
    """How much hotter a sector is than those as built up as it is."""
    s = _heat(spark, folder).groupBy("sector").agg(F.median("v").alias("m"), F.avg((F.col("c") + F.col("r")) % 7).alias("built"))
    t = terciles(s, "built")
    anomaly = F.col("m") - F.median("m").over(Window.partitionBy("tercile"))
    return t.select("sector", "tercile", F.round(anomaly, 6).alias("anomaly"), (anomaly >= 1).alias("hotter"))


@query(f"with {_HEAT}, p as (select a.scene, a.m as x, b.m as y from yearly a join yearly b on a.sector = b.sector and b.scene = a.scene + 1), k as (select scene, rank() over (partition by scene order by x) + (count(*) over (partition by scene, x) - 1) / 2.0 as a, rank() over (partition by scene order by y) + (count(*) over (partition by scene, y) - 1) / 2.0 as b from p) select scene, round(corr(a, b), 6) as rho, count(*) as n from k group by 1")
def heat_stability(spark: SparkSession, folder: str) -> DataFrame:
    """Rank correlation of the sectors' heat in adjacent years."""
    yearly = _heat(spark, folder).groupBy("sector", "scene").agg(F.median("v").alias("m"))
    later = yearly.select("sector", (F.col("scene") - 1).alias("scene"), F.col("m").alias("y"))
    return spearman(yearly.withColumnRenamed("m", "x").join(later, ["sector", "scene"]), "x", "y", ["scene"]).withColumn("rho", F.round("rho", 6))


@query(f"""with {SCENES}, d as (select date_trunc('month', day)::date as month, avg(cloud) as v from sc where cloud is not null group by 1), p as (select a.month, a.v, b.v as o, row_number() over (partition by a.month order by b.v) - 1 as k, count(b.v) over (partition by a.month) as n from d a left join d b on month(a.month) = month(b.month) and year(a.month) <> year(b.month))
 select month, round(max(v) - max(case when k = n // 2 then o end), 6) as deviation from p group by 1""")
def same_month_deviation(spark: SparkSession, folder: str) -> DataFrame:
    d = scenes(spark, folder).filter("cloud is not null").groupBy(F.trunc("day", "month").alias("month")).agg(F.avg("cloud").alias("v"))
    return S.peer_deviation(d, "month", "v").select("month", F.round("deviation", 6).alias("deviation"))


@query("with y as (select o_orderpriority as unit, year(o_orderdate)::bigint as y, count(*) as n from orders group by 1, 2) select unit, y, n - lag(n) over (partition by unit order by y) as change, arg_max(y, n * 10000 - y) over (partition by unit) as best from y")
def yearly_changes(spark: SparkSession, folder: str) -> DataFrame:
    y = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    best = y.groupBy("unit").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("best"))
    return y.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("unit").orderBy("y"))).join(best, "unit").select("unit", "y", "change", "best")


@query("select o_orderkey, year(o_orderdate)::varchar || '-' || o_orderpriority[1] || '-' || lpad(row_number() over (partition by o_custkey, year(o_orderdate), o_orderpriority[1] order by o_orderkey)::varchar, 3, '0') as name from orders")
def counted_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names with an ordinal in their year."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), F.substring("o_orderpriority", 1, 1).alias("p"))
    k = F.row_number().over(Window.partitionBy("o_custkey", "y", "p").orderBy("o_orderkey"))
    return o.select("o_orderkey", F.concat_ws("-", F.col("y").cast("string"), "p", F.lpad(k.cast("string"), 3, "0")).alias("name"))


@query("with m as (select o_orderpriority as unit, date_trunc('month', o_orderdate)::date as m, count(*)::double as n from orders group by 1, 2) select unit, round(sum(case when m > date '1997-03-10' then n when last_day(m) >= date '1997-03-10' then n * date_diff('day', date '1997-03-10', last_day(m)) / day(last_day(m)) else 0 end), 6) as after from m group by 1")
def prorated_flows(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.trunc("o_orderdate", "month").alias("m")).agg(F.count("*").cast("double").alias("n"))
    return m.groupBy("unit").agg(F.round(S.flows_after(m, "m", "n", F.lit("1997-03-10").cast("date")), 6).alias("after"))


@query(f"with {SCENES}, d as (select scene_id % 97 as path, tile, day, min(scene_id) as scene_id from sc group by 1, 2, 3), s as (select path, tile, count(*) as days, arg_min(scene_id, day) as first_scene, arg_max(scene_id, day) as last_scene, date_diff('day', min(day), max(day)) as span from d group by 1, 2) select * from s where days >= 2")
def stacks(spark: SparkSession, folder: str) -> DataFrame:
    """Stacks of granules, the first seen of a day, at least two days, with the pair of their first and last."""
    s = scenes(spark, folder).select((F.col("scene_id") % 97).alias("path"), "tile", "day", "scene_id")
    d = S.first_seen(s, ["path", "tile", "day"], F.col("scene_id"))
    out = d.groupBy("path", "tile").agg(F.count("*").alias("days"), F.min_by("scene_id", "day").alias("first_scene"), F.max_by("scene_id", "day").alias("last_scene"), F.datediff(F.max("day"), F.min("day")).cast("long").alias("span"))
    return out.filter("days >= 2").orderBy(F.desc("days"), "path", "tile")


@query(f"with {SCENES}, p as (select distinct scene_id % 97 as path, tile, day from sc), q as (select path, tile, day as first, lead(day) over (partition by path, tile order by day) as second from p) select path, tile, first, second from q where month(first) between 7 and 10 and month(second) between 7 and 10")
def reliable_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = D.consecutive(scenes(spark, folder).withColumn("path", F.col("scene_id") % 97), ["path", "tile"], "day")
    return pairs.filter(R.reliable_pair(F.col("first"), F.col("second"))).select("path", "tile", "first", "second")


@query(f"with {SCENES} select day, count(*) as scenes, round(avg(cloud), 6) as cloud from sc group by 1")
def newest_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """All days with scenes, newest first, with the mean of the clouds that are known."""
    return scenes(spark, folder).groupBy("day").agg(F.count("*").alias("scenes"), F.round(F.avg("cloud"), 6).alias("cloud")).orderBy(F.desc("day"))


@query(f"with {SCENES}, d as (select day, avg(cloud) as cloud from sc group by 1), k as (select *, row_number() over (partition by year(day) order by coalesce(cloud, 100), abs(date_diff('day', day, make_date(year(day), 9, 20))), day) as k from d where day between make_date(year(day), 8, 15) and make_date(year(day), 10, 31)) select year(day)::bigint as year, day, round(cloud, 6) as cloud from k where k = 1")
def cleanest_near_day(spark: SparkSession, folder: str) -> DataFrame:
    """Each year's cleanest day from 15 August to 31 October, of equals the one nearest to 20 September, then the first; unknown clouds count as 100."""
    at = lambda m, d: F.make_date(F.year("day"), F.lit(m), F.lit(d))
    d = scenes(spark, folder).filter(F.col("day").between(at(8, 15), at(10, 31))).groupBy("day").agg(F.avg("cloud").alias("cloud"))
    order = F.struct(F.coalesce("cloud", F.lit(100.0)), F.abs(F.datediff(at(9, 20), "day")), "day")
    best = d.groupBy(F.year("day").cast("long").alias("year")).agg(F.min_by(F.struct("day", "cloud"), order).alias("x"))
    return best.select("year", "x.day", F.round("x.cloud", 6).alias("cloud"))


@query(f"with {SCENES}, d as (select day, min(cloud) as cloud from sc where day >= date '1998-01-01' group by 1), t as (select min(case when cloud <= 1 then 0 when cloud <= 5 then 1 when cloud <= 10 then 2 when cloud is not null then 3 end) as best from d) select day, cloud from d, t where cloud is null or case when cloud <= 1 then 0 when cloud <= 5 then 1 when cloud <= 10 then 2 else 3 end <= best")
def cloud_tiers(spark: SparkSession, folder: str) -> DataFrame:
    d = scenes(spark, folder).filter("day >= date'1998-01-01'").groupBy("day").agg(F.min("cloud").alias("cloud"))
    return S.tier_cut(d, "cloud", [1, 5, 10])


@query(f"with {SCENES}, d as (select strftime(day, '%Y-%m') as month, day, min(cloud) as stated, sum(scene_id) % 40 as measured from sc group by 1, 2), k as (select *, row_number() over (partition by month order by coalesce(stated, 99), day) as k from d), f as (select *, row_number() over (partition by month order by measured, k) as j from k where k <= 4 and measured <= 10) select month, day, measured::bigint as measured from f where j = 1")
def measured_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Each month's best of its four candidates by cloud measured over the area."""
    d = scenes(spark, folder).groupBy(F.date_format("day", "yyyy-MM").alias("month"), "day").agg(F.min("cloud").alias("stated"), (F.sum("scene_id") % 40).alias("measured"))
    return S.best_measured(d, ["month"], "stated", "measured")


@query(f"with {SCENES}, s as (select strftime(day, '%Y-%m') as month, case when min(cloud) <= 2 then min(cloud) end as cloud from sc where tile = 0 group by 1), f as (select strftime(day, '%Y-%m') as month, min(cloud) as cloud from sc group by 1), x as (select * from s where month < '1997-06') select * from x union all select * from f where month not in (select month from x)")
def merged_history(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly table after a run in June 1997: closed months stay, empty ones too."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    s = scenes(spark, folder)
    stored = s.filter("tile = 0").groupBy(month).agg(F.min("cloud").alias("cloud")).withColumn("cloud", F.when(F.col("cloud") <= 2, F.col("cloud")))
    return S.merged_months(stored, s.groupBy(month).agg(F.min("cloud").alias("cloud")), "1997-06")


@query(f"with {SCENES} select scene_id, day, cloud from sc where tile = 1 and year(day) = (select max(year(day)) from sc where tile = 1) and day not in (date '2001-01-05', date '2001-02-11', date '1998-07-04')")
def product_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a platform from its most recent year, without excluded dates."""
    s = scenes(spark, folder).withColumn("platform", F.when(F.col("tile") == 1, "Aqua").otherwise("Terra")).filter(F.lower("platform") == "aqua")
    last = s.agg(F.max(F.year("day")).alias("y"))
    excluded = spark.createDataFrame([("2001-01-05",), ("2001-02-11",), ("1998-07-04",)], "day string").select(F.col("day").cast("date").alias("day"))
    return s.join(F.broadcast(last), F.year("day") == F.col("y")).join(F.broadcast(excluded), "day", "left_anti").select("scene_id", "day", "cloud")


_CURVE = """e as (select o_custkey as unit, date_trunc('month', o_orderdate)::date as m, count(*) as n from orders group by 1, 2), a as (select unit, min(m) as a, max(m) as b from e group by 1),
 s as (select unit, a, unnest(generate_series(a::timestamp, b::timestamp, interval 1 month))::date as m from a), curve as (select unit, date_diff('month', a, m) as age, least(sum(coalesce(n, 0)) over (partition by unit order by m) / 8.0::double, 1.0) as share from s left join e using (unit, m)),
 ref as (select age, median(share) as reference, quantile_cont(share, 0.25) as low, quantile_cont(share, 0.75) as high from curve group by 1)"""


def _curves(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("m"), F.lit(1).alias("n"), F.lit(8.0).alias("cap"))
    return T.cohort_curve(o, "unit", "m", "n", "cap")


@query(f"with {_CURVE} select age, round(reference, 6) as reference, round(low, 6) as low, round(high, 6) as high from ref")
def ageing_curve(spark: SparkSession, folder: str) -> DataFrame:
    """Median share of capacity at each age over all units, with quartiles."""
    return S.ageing_curve(_curves(spark, folder), "age", "share").select("age", *[F.round(c, 6).alias(c) for c in ("reference", "low", "high")])


@query(f"with {_CURVE}, own as (select unit, least(24, max(age)) as age from curve group by 1), r as (select unit, curve.share / reference as ratio from own join curve using (unit, age) join ref using (age)), k as (select case when ratio < (1.0 / 3) / r24 then 'baja' when ratio >= (2.0 / 3) / r24 then 'alta' else 'media' end as class from r, (select reference as r24 from ref where age = 24)) select class, count(*) as units, round(count(*) / sum(count(*)) over (), 6) as share from k group by 1")
def ageing_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Units by their share of capacity against the reference of their age, at most 24 months."""
    curves = saved(_curves(spark, folder), "curves")
    ref = S.ageing_curve(curves, "age", "share").select("age", "reference")
    at = curves.groupBy("unit").agg(F.least(F.lit(24), F.max("age")).alias("age"))
    rows = at.join(curves, ["unit", "age"]).join(ref, "age").select((F.col("share") / F.col("reference")).alias("ratio"))
    rows = rows.join(F.broadcast(ref.filter("age = 24").select(F.col("reference").alias("r24"))))
    counts = rows.groupBy(S.ageing_class(F.col("ratio"), F.col("r24")).alias("class")).agg(F.count("*").alias("units"))
    return counts.join(F.broadcast(counts.agg(F.sum("units").alias("all")))).select("class", "units", F.round(F.col("units") / F.col("all"), 6).alias("share"))


@query("with y as (select c_nationkey::bigint as unit, year(o_orderdate)::bigint as y, count(*) as n, count(distinct month(o_orderdate)) as months from orders join customer on o_custkey = c_custkey group by 1, 2), t as (select y from (select year(o_orderdate)::bigint as y, count(distinct month(o_orderdate)) as m from orders group by 1) where m = 12) select unit, string_agg(y || ':' || n, ',' order by y) as pace from y join t using (y) group by 1")
def growth_pace(spark: SparkSession, folder: str) -> DataFrame:
    """Each unit's additions by year, years without all twelve months cut."""
    o = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    whole = o.groupBy("y").agg(F.count_distinct("m").alias("months")).filter("months = 12").select("y")
    n = o.join(F.broadcast(whole), "y").join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("unit")), "o_custkey").groupBy("unit", "y").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("y", "n")))
    return n.groupBy("unit").agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["y"].cast("string"), x["n"].cast("string"))), ",").alias("pace"))


@query(f"with {PIXELS}, f as (select r, c, scene, coalesce(swir1 >= 0.1, false)::int as f from px), g as (select r, c, scene, min(f) over (partition by r, c order by scene desc) as f from f), s as (select r, c, min(scene) as since from g where f = 1 group by 1, 2) select case when since <= 1996 then '1995-1996' when since <= 1998 then '1997-1998' else '1999-2001' end as period, count(*) as cells, count(*) * {HA} as ha from s group by 1")
def urbanized_by_period(spark: SparkSession, folder: str) -> DataFrame:
    flagged = pixels(spark, folder).withColumn("f", F.coalesce(F.col("swir1") >= 0.1, F.lit(False)))
    since = P.built_since(flagged, "scene", "f")
    period = F.when(F.col("since") <= 1996, "1995-1996").when(F.col("since") <= 1998, "1997-1998").otherwise("1999-2001")
    return since.groupBy(period.alias("period")).agg(F.count("*").alias("cells"), (F.count("*") * HA).alias("ha"))


@query(f"with {PIXELS}, v as (select r, c, scene % 2 as half, median({NDVI}) as v from px group by 1, 2, 3), k as (select half::bigint as half, case when v is null then 0 when v < 0.2 then 1 when v < 0.4 then 2 when v < 0.6 then 3 else 4 end::bigint as class from v) select half, class, count(*) * {HA} as ha from k group by 1, 2")
def vegetation_by_composite(spark: SparkSession, folder: str) -> DataFrame:
    """Hectares of the vegetation classes in the composites of odd and even years."""
    v = pixels(spark, folder).groupBy("r", "c", (F.col("scene") % 2).cast("long").alias("half")).agg(F.median(R.index("NDVI")).alias("v"))
    return v.groupBy("half", R.vegetation_class(F.col("v")).cast("long").alias("class")).agg((F.count("*") * HA).alias("ha"))


@query(f"with {PIXELS}, m as (select scene, median(red) as a, median(nir) as b, count(red) as n from px group by 1) select scene::bigint as scene, round(a - b, 6) as difference, n from m")
def collection_contrast(spark: SparkSession, folder: str) -> DataFrame:
    """Two collections of one day: the difference of their medians."""
    p = pixels(spark, folder).groupBy(F.col("scene").cast("long").alias("scene")).agg(F.median("red").alias("a"), F.median("nir").alias("b"), F.count("red").alias("n"))
    return p.select("scene", F.round(F.col("a") - F.col("b"), 6).alias("difference"), "n")


@query(_zones_sql("abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1", 1).rsplit("select zone, count(*)", 1)[0] + f" select zone, count(*) as cells, count(*) * {HA} as ha, round(avg((r between 8 and 23)::int), 6) as urban from z join own on own.id = z.x group by 1")
def growth_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Zones of change and the share of each inside the city."""
    changed = P.construction(pixels(spark, folder), 1995, 1996).filter("state <> 'none'")
    z = label(changed, saved).groupBy("zone")
    return z.agg(F.count("*").alias("cells"), (F.count("*") * HA).alias("ha"), F.round(F.avg(F.col("r").between(8, 23).cast("double")), 6).alias("urban"))


@query(f"with {PIXELS}, v as (select scene::bigint as scene, avg({NDVI}) as mean, median({NDVI}) as median, count({NDVI}) / pow({SIDE}, 2) as valid from px group by 1) select printf('%d,%.4f,%.4f,%.3f', scene, mean, median, valid) as line from v")
def series_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The series as lines with fixed decimals."""
    v = pixels(spark, folder).groupBy("scene").agg(F.avg(R.index("NDVI")).alias("mean"), F.median(R.index("NDVI")).alias("median"), (F.count(R.index("NDVI")) / float(side(spark, folder) ** 2)).alias("valid"))
    return v.select(F.format_string("%d,%.4f,%.4f,%.3f", "scene", "mean", "median", "valid").alias("line"))


@query("select c_mktsegment, format('{:,}', sum(c_custkey)::bigint) as total from customer group by 1")
def formatted_totals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(F.format_number(F.sum("c_custkey"), 0).alias("total"))


@query(f"with {PIXELS}, k as (select scene::bigint as scene, count(red) as red, count(nir) as nir, count(swir1) as swir1, count(green) as green from px group by 1), n as (select scene, unnest(case when red > 0 and nir > 0 then ['nir', 'red'] else [] end || case when green > 0 and nir > 0 then ['green', 'nir'] else [] end || case when green > 0 and swir1 > 0 then ['green', 'swir1'] else [] end || case when swir1 > 0 and nir > 0 then ['swir1', 'nir'] else [] end) as band from k) select scene, string_agg(distinct band, ',' order by band) as bands from n group by 1")
def needed_bands(spark: SparkSession, folder: str) -> DataFrame:
    """The bands that the indices a scene can give need, each once."""
    names = ("NDVI", "NDWI", "MNDWI", "NDBI")
    have = pixels(spark, folder).groupBy(F.col("scene").cast("long").alias("scene")).agg(*[F.count(b).alias(b) for b in ("red", "nir", "swir1", "green")])
    usable = [F.when(F.least(*[F.col(b) for b in R.INDICES[n]]) > 0, F.array(*[F.lit(b) for b in R.INDICES[n]])).otherwise(F.array().cast("array<string>")) for n in names]
    return have.select("scene", F.array_distinct(F.concat(*usable)).alias("b")).filter("size(b) > 0").select("scene", F.array_join(F.array_sort("b"), ",").alias("bands"))


@query("select s_suppkey, case s_suppkey % 3 when 0 then 'PARK' when 1 then 'SPORT' else 'WOOD' end as uses, 2000 + s_suppkey % 20 as year, s_name as name from supplier")
def kml_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of placemarks in XML: name, year from the folder's path, and an attribute from the table in the description."""
    use = F.element_at(F.array(*[F.lit(x) for x in ("PARK", "SPORT", "WOOD")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    xml = F.concat(F.lit("<Folder><name>zones/"), (2000 + F.col("s_suppkey") % 20).cast("string"), F.lit("/a</name><Placemark><name>"), "s_name", F.lit("</name><description>&lt;td&gt;USOS&lt;/td&gt; &lt;td&gt;"), use, F.lit("&lt;/td&gt;</description></Placemark></Folder>"))
    d = table(spark, folder, "supplier").select("s_suppkey", xml.alias("xml"))
    return d.select("s_suppkey", R.placemark_attribute(F.expr("xpath_string(xml, '/Folder/Placemark/description')"), "USOS").alias("uses"), F.regexp_extract(F.expr("xpath_string(xml, '/Folder/name')"), r"(20\d\d)", 1).cast("int").alias("year"), F.expr("xpath_string(xml, '/Folder/Placemark/name')").alias("name"))


@query("with w as (select s_suppkey as way, (s_suppkey * 7907 % 1007) / 10.0::double as x0, (s_suppkey * 6101 % 1009) / 10.0::double as y0, (s_suppkey * 7907 % 1007) / 10.0::double + s_suppkey % 90 as x1, (s_suppkey * 6101 % 1009) / 10.0::double + s_suppkey % 70 as y1 from supplier where s_suppkey % 4 <> 0), n as (select *, greatest(1, ceil(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / 25))::int as n from w), p as (select way, n, i, round((x0 + (x1 - x0) * i / n) / 0.1::double)::bigint as ax, round((y0 + (y1 - y0) * i / n) / 0.1::double)::bigint as ay, round((x0 + (x1 - x0) * (i + 1) / n) / 0.1::double)::bigint as bx, round((y0 + (y1 - y0) * (i + 1) / n) / 0.1::double)::bigint as by_ from n, range(100) t(i) where i < n) select count(*) as pieces, count(distinct (ax, ay, bx, by_)) as edges, count(distinct way) as ways, sum(ax + ay + bx + by_)::bigint as check_ from p")
def walking_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Public ways cut into pieces of 25 m at most, their nodes snapped to 0.1 m."""
    from geolattice.operators.network import split_ways

    ways = table(spark, folder, "supplier").filter("s_suppkey % 4 <> 0").selectExpr("s_suppkey as way", "(s_suppkey * 7907 % 1007) / 10.0D as x0", "(s_suppkey * 6101 % 1009) / 10.0D as y0").selectExpr("way", "x0", "y0", "x0 + way % 90 as x1", "y0 + way % 70 as y1")
    p = split_ways(ways, 25.0, 0.1)
    return p.agg(F.count("*").alias("pieces"), F.count_distinct("ax", "ay", "bx", "by").alias("edges"), F.count_distinct("way").alias("ways"), F.sum(F.col("ax") + F.col("ay") + F.col("bx") + F.col("by")).alias("check_"))
