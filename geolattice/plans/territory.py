"""Queries on dates, territorial units, catalogs and text fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.functions import radiometry as R
from geolattice.functions.order_stats import spearman, terciles, with_average_rank
from geolattice.operators import dates as D
from geolattice.operators import quadtree as Q
from geolattice.operators import territory as T
from geolattice.operators.polygons import hexagon
from geolattice.plans.fixtures import SCENES, scenes
from geolattice.plans.registry import query
from geolattice.session import saved, table
from geolattice.sources.reports import legend_json, measurements
from geolattice.streaming.monitor import daily

LOCAL = "(ts - interval 6 hour)"


@query(f"with {SCENES} select day, count(*) as scenes, round(avg(cloud), 6) as cloud from sc group by 1")
def scene_days(spark: SparkSession, folder: str) -> DataFrame:
    return D.by_day(scenes(spark, folder), "UTC").withColumn("cloud", F.round("cloud", 6))


@query(f"with {SCENES} select scene_id, day, cloud from sc where cloud < 20 and day between date '1996-01-01' and date '1996-06-30'")
def scene_filter(spark: SparkSession, folder: str) -> DataFrame:
    return scenes(spark, folder).filter("cloud < 20 and day between date'1996-01-01' and date'1996-06-30'").select("scene_id", "day", "cloud")


@query(f"with {SCENES}, d as (select day, row_number() over (order by day) - 1 as k, count(*) over () as n from (select distinct day from sc)) select day from d where k in (select floor(i * (n - 1) / 11.0 + 0.5) from range(12) t(i), (select max(n) as n from d))")
def even_sample(spark: SparkSession, folder: str) -> DataFrame:
    return D.even_sample(scenes(spark, folder), 12)


@query(f"""with {SCENES}, d as (select tile, day, date_diff('day', day, date '1997-06-30') as back from sc), t as (select *, case when abs(back - 30) <= 3 and tile = 0 then 1 when abs(back - 30) <= 3 then 1 when back between 14 and 75 then 2 end as tier from d),
 k as (select *, row_number() over (partition by tile order by tier, abs(back - 30), back) as k from t where tier is not null) select tile, day, tier::bigint as tier from k where k = 1""")
def base_date(spark: SparkSession, folder: str) -> DataFrame:
    return D.base_date(scenes(spark, folder), F.lit("1997-06-30").cast("date"), within=3, keys=["tile"]).withColumn("tier", F.col("tier").cast("long"))


@query(f"""with {SCENES}, d as (select distinct scene_id % 97 as path, tile, day from sc), p as (select *, lead(day) over (partition by path, tile order by day) as second from d)
 select path, tile, day as first, second, date_diff('day', day, second) as days, case when second - day <= 12 then 'good' when second - day <= 48 then 'acceptable' else 'doubtful' end as grade from p where second is not null""")
def consecutive_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = D.consecutive(scenes(spark, folder).withColumn("path", F.col("scene_id") % 97), ["path", "tile"], "day")
    return pairs.withColumn("days", F.col("days").cast("long"))


@query(f"with {SCENES}, d as (select day, avg(cloud) as v from sc where cloud is not null group by 1), m as (select *, median(v) over (partition by month(day)) as m from d) select day, round(m, 6) as month_median, abs(v - m) > 30 as outlier from m")
def seasonal_outliers(spark: SparkSession, folder: str) -> DataFrame:
    days = scenes(spark, folder).filter("cloud is not null").groupBy("day").agg(F.avg("cloud").alias("v"))
    return D.seasonal_outliers(days, "v", 30).select("day", F.round("month_median", 6).alias("month_median"), "outlier")


@query(f"with {SCENES}, k as (select strftime(day, '%Y-%m') as month, day, cloud, row_number() over (partition by strftime(day, '%Y-%m') order by cloud, day desc) as k from sc where cloud is not null) select month, case when cloud <= 3 then day end as day, case when cloud <= 3 then cloud end as cloud from k where k = 1")
def monthly_history(spark: SparkSession, folder: str) -> DataFrame:
    return D.best_of_month(scenes(spark, folder).filter("cloud is not null").select("day", "cloud"), 3)


@query(f"with {SCENES}, b as (select tile, day as d2, max(cloud) as cloud from sc where cloud is not null group by 1, 2) select sc.scene_id, sc.tile, sc.day, b.cloud from sc asof left join b on sc.tile = b.tile and sc.day >= b.d2")
def as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The latest known cloud at or before each scene's day; it is looked up for each tile and day, and scenes are joined to it."""
    s = scenes(spark, folder)
    right = s.filter("cloud is not null").groupBy("tile", "day").agg(F.max("cloud").alias("cloud"))
    days = D.as_of(s.select("tile", "day").distinct(), right, ["tile"], "day", "day", "cloud")
    return s.select("scene_id", "tile", "day").join(days, ["tile", "day"]).select("scene_id", "tile", "day", "cloud")


@query("select n_nationkey::bigint as unit, strftime(m, '%Y-%m') as month, last_day(m)::date as last from (select n_nationkey, unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as m from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1)")
def month_list(spark: SparkSession, folder: str) -> DataFrame:
    """Each unit's months from its first to its last date, with none left out."""
    own = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("unit")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    months = own.select("unit", F.explode(D.months_between_inclusive(F.col("a"), F.col("b"))).alias("m"))
    return months.select("unit", F.date_format("m", "yyyy-MM").alias("month"), F.last_day("m").alias("last"))


@query("""with g as (select n_nationkey, count(*) as n, sum(c_acctbal) as bal, min(c_acctbal) as low from customer join nation on c_nationkey = n_nationkey group by 1),
 l as (select n_nationkey, unnest([n::double, bal, low]) as v, unnest(['a', 'b', 'c']) as s from g), k as (select n_nationkey, rank() over (partition by s order by v desc) as k from l) select n_nationkey::bigint as unit, sum((k <= 8)::int)::bigint as votes, min(k) as best from k group by 1""")
def rank_votes(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("long").alias("unit")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("bal"), F.min("c_acctbal").alias("low"))
    return T.votes(g, "unit", ["n", "bal", "low"], 8)


@query("select p_partkey, p_size::bigint as p_size, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as place from part")
def average_ranks(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return with_average_rank(p, "p_size", "place").select("p_partkey", "p_size", "place")


@query("""with e as (select c_nationkey, quantile_cont(c_acctbal, 1.0 / 3) as a, quantile_cont(c_acctbal, 2.0 / 3) as b from customer group by 1), t as (select c_custkey, c_nationkey, c_acctbal, case when c_acctbal <= a then 1 when c_acctbal <= b then 2 else 3 end as tercile from customer join e using (c_nationkey)),
 m as (select *, c_acctbal - median(c_acctbal) over (partition by c_nationkey, tercile) as anomaly from t) select c_custkey, tercile::bigint as tercile, round(anomaly, 4) as anomaly from m""")
def tercile_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    t = terciles(table(spark, folder, "customer"), "c_acctbal", ["c_nationkey"])
    m = F.median("c_acctbal").over(Window.partitionBy("c_nationkey", "tercile"))
    return t.select("c_custkey", "tercile", F.round(F.col("c_acctbal") - m, 4).alias("anomaly"))


@query("with k as (select p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0 as a, rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0 as b from part) select p_brand, round(corr(a, b), 6) as rho, count(*) as n from k group by 1")
def rank_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return spearman(table(spark, folder, "part"), "p_size", "p_retailprice", ["p_brand"]).withColumn("rho", F.round("rho", 6))


@query("""with e as (select o_custkey as unit, date_trunc('month', o_orderdate)::date as m, count(*) as n from orders group by 1, 2), a as (select unit, min(m) as a, max(m) as b from e group by 1),
 s as (select unit, a, unnest(generate_series(a::timestamp, b::timestamp, interval 1 month))::date as m from a) select unit, date_diff('month', a, m) as age, round(least(sum(coalesce(n, 0)) over (partition by unit order by m) / 8.0, 1.0), 6) as share from s left join e using (unit, m)""")
def cohort_curves(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("m"), F.lit(1).alias("n"), F.lit(8.0).alias("cap"))
    return T.cohort_curve(o, "unit", "m", "n", "cap").withColumn("share", F.round("share", 6))


@query("with f as (select o_orderpriority as unit, year(o_orderdate)::bigint as y, count(*) as n from orders group by 1, 2) select unit, y, n, 100000 - coalesce(sum(n) over (partition by unit order by y rows between 1 following and unbounded following), 0)::bigint as stock from f")
def reverse_stock(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))
    return T.stock_before(f, ["unit"], "y", "n", F.lit(100000))


@query("with f as (select o_orderpriority as unit, year(o_orderdate) as y, count(*) as n from orders group by 1, 2), s as (select unit, n / sum(n) over (partition by y) as s from f) select unit, round(avg(s), 6) as share, count(*) as periods from s group by 1")
def contribution(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("unit"), F.year("o_orderdate").alias("y"), F.lit(1).alias("n"))
    return T.contribution(o, "unit", "y", "n").withColumn("share", F.round("share", 6))


@query("select c_mktsegment, round(sum(c_acctbal * (c_custkey % 7 + 1)) / sum(c_custkey % 7 + 1), 6) as mean from customer group by 1")
def weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    return T.weighted_mean(table(spark, folder, "customer").withColumn("w", F.col("c_custkey") % 7 + 1), ["c_mktsegment"], "c_acctbal", "w").withColumn("mean", F.round("mean", 6))


@query("""with o as (select n_nationkey, n_regionkey::varchar as zone, (n_nationkey % 4 + 1) / 5.0 as share from nation where n_nationkey % 6 <> 0), v as (select c_nationkey as n_nationkey, sum(c_custkey)::double as v from customer group by 1),
 s as (select zone, sum(v * share) as value from v join o using (n_nationkey) group by 1) select zone, round(value, 4) as value from s union all select 'outside', round((select sum(v) from v) - (select sum(value) from s), 4)""")
def areal_split(spark: SparkSession, folder: str) -> DataFrame:
    shares = table(spark, folder, "nation").filter("n_nationkey % 6 <> 0").select("n_nationkey", F.col("n_regionkey").cast("string").alias("zone"), ((F.col("n_nationkey") % 4 + 1) / 5.0).alias("share"))
    values = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_custkey").cast("double").alias("value"))
    return T.areal_split(values, shares, "n_nationkey", "zone", "value", "outside").withColumn("value", F.round("value", 4))


@query("select cut::bigint as cut, round(sum(case when abs(c_acctbal) <= cut then c_custkey else 0 end) / sum(c_custkey), 6) as share from customer, (values (100), (1000), (5000), (20000)) t(cut) group by 1")
def access_curve(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "customer").withColumn("d", F.abs("c_acctbal"))
    return T.access_curve(people, "d", "c_custkey", [100, 1000, 5000, 20000]).withColumn("share", F.round("share", 6))


@query("with p as (select l_suppkey as origin, l_quantity / 5 as ha, l_partkey % 1000 as d from lineitem) select origin, bool_or((ha >= 0.5 and d <= 4) or (ha >= 4 and d <= 6) or (ha >= 7.5 and d <= 8)) as meets from p group by 1")
def three_distance_test(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("origin"), (F.col("l_quantity") / 5).alias("ha"), (F.col("l_partkey") % 1000).alias("d"))
    return T.meets_any(pairs, "origin", [(0.5, 4), (4, 6), (7.5, 8)])


_POINTS = "p as (select c_custkey as id, (c_custkey * 7919 % 10007) / 10.0 as x, (c_custkey * 104729 % 10009) / 10.0 as y from customer), q as (select s_suppkey as place, (s_suppkey * 7907 % 10007) / 10.0 as px, (s_suppkey * 6101 % 10009) / 10.0 as py from supplier)"


@query(f"with {_POINTS}, n as (select id, place, sqrt((x - px) * (x - px) + (y - py) * (y - py)) as d from p, q), k as (select *, row_number() over (partition by id order by d, place) as k from n where d <= 100) select id, place, round(d, 6) as d from k where k = 1")
def nearest_place(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "customer").selectExpr("c_custkey as id", "(c_custkey * 7919 % 10007) / 10.0D as x", "(c_custkey * 104729 % 10009) / 10.0D as y")
    q = table(spark, folder, "supplier").selectExpr("s_suppkey as place", "(s_suppkey * 7907 % 10007) / 10.0D as px", "(s_suppkey * 6101 % 10009) / 10.0D as py")
    return Q.nearest_place(p, q, saved).filter("d <= 100").withColumn("d", F.round("d", 6))


@query(f"""with {_POINTS}, a as (select id, (sqrt(3) / 3 * x - y / 3) / 50 as q, (2.0 / 3 * y) / 50 as r from p), b as (select id, q, r, -q - r as s, floor(q + 0.5) as rq, floor(r + 0.5) as rr, floor(-q - r + 0.5) as rs from a),
 h as (select case when abs(rq - q) > abs(rr - r) and abs(rq - q) > abs(rs - s) then -rr - rs else rq end as q, case when not (abs(rq - q) > abs(rr - r) and abs(rq - q) > abs(rs - s)) and abs(rr - r) > abs(rs - s) then -rq - rs else rr end as r from b) select q::bigint as q, r::bigint as r, count(*) as n from h group by 1, 2""")
def hexagon_counts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "customer").selectExpr("(c_custkey * 7919 % 10007) / 10.0D as x", "(c_custkey * 104729 % 10009) / 10.0D as y")
    q, r = hexagon(F.col("x"), F.col("y"), 50.0)
    return p.groupBy(q.cast("long").alias("q"), r.cast("long").alias("r")).agg(F.count("*").alias("n"))


@query("""with b as (select p_partkey, p_size + 45.0 as cn, p_retailprice / 1000 as km2, p_partkey % 40 as ha from part), m as (select p_partkey, cn + (98 - cn) * least(1.0, ha / (km2 * 100)) as cn2, cn, km2 from b),
 d as (select *, 25400 / cn - 254 as s, 25400 / cn2 - 254 as s2 from m) select p_partkey, round(case when 60 <= 0.2 * s then 0 else pow(60 - 0.2 * s, 2) / (60 + 0.8 * s) end * km2 * 1000, 4) as before_m3, round(case when 60 <= 0.2 * s2 then 0 else pow(60 - 0.2 * s2, 2) / (60 + 0.8 * s2) end * km2 * 1000, 4) as after_m3 from d""")
def runoff(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "part").select("p_partkey", (F.col("p_size") + 45.0).alias("cn"), (F.col("p_retailprice") / 1000).alias("km2"), (F.col("p_partkey") % 40).alias("ha"))
    volume = lambda cn: F.round(R.runoff_depth(F.lit(60.0), cn) * F.col("km2") * 1000, 4)
    return b.select("p_partkey", volume(F.col("cn")).alias("before_m3"), volume(R.mixed_curve_number(F.col("cn"), F.col("ha"), F.col("km2"))).alias("after_m3"))


@query(f"select {LOCAL}::date as day, event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean from events group by 1, 2")
def local_days(spark: SparkSession, folder: str) -> DataFrame:
    return daily(table(spark, folder, "events")).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query("select event_type, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as k from events where json_extract(props, '$.k')::bigint >= 10 group by 1")
def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, folder, "events").filter(k >= 10).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("select n_name, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from nation")
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select("n_name", R.slug(F.col("n_name")).alias("slug"))


@query("select * from (select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by md5(c_custkey::varchar), c_custkey) as k from customer) where k <= 11)")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return T.stratified_sample(table(spark, folder, "customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], "c_custkey", 11)


@query("select c_nationkey::bigint as unit, " + ", ".join(f"coalesce(sum(case when c_mktsegment = '{s}' then c_custkey end), 0)::bigint as {s.lower()}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " from customer group by 1")
def sector_pivot(spark: SparkSession, folder: str) -> DataFrame:
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    wide = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("long").alias("unit")).pivot("c_mktsegment", names).agg(F.sum("c_custkey"))
    return wide.select("unit", *[F.coalesce(F.col(n), F.lit(0)).alias(n.lower()) for n in names])


@query("with r as (select s_suppkey, rank() over (order by s_acctbal desc) as a, rank() over (order by s_suppkey % 37 desc) as b, rank() over (order by s_nationkey desc) as c from supplier) select s_suppkey, case when a <= 40 and b <= 40 and c <= 40 then 'all' when a <= 40 or b <= 40 or c <= 40 then 'some' end as place from r where a <= 40 or b <= 40 or c <= 40")
def top_in_all(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), (F.col("s_suppkey") % 37).alias("b"), F.col("s_nationkey").alias("c"))
    return T.votes(s, "s_suppkey", ["a", "b", "c"], 40).filter("votes > 0").select("s_suppkey", F.when(F.col("votes") == 3, "all").otherwise("some").alias("place"))


@query("select 'a' as source, s_suppkey as id, s_acctbal as balance, null as name from supplier union all select 'b', c_custkey, null, c_name from customer")
def measurement_union(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "supplier").selectExpr("'a' as source", "s_suppkey as id", "s_acctbal as balance")
    b = table(spark, folder, "customer").selectExpr("'b' as source", "c_custkey as id", "c_name as name")
    return measurements([a, b])


@query("select c_mktsegment as result, '{\"result\":\"' || c_mktsegment || '\",\"legend\":[' || string_agg('{\"class\":' || c || ',\"detail\":' || n || '}', ',' order by c) || ']}' as json from (select c_mktsegment, c_nationkey as c, count(*) as n from customer group by 1, 2) group by 1")
def legend(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("result"), F.col("c_nationkey").alias("class")).agg(F.count("*").alias("detail"))
    return legend_json(counts)


@query("""with y as (select l_suppkey as unit, year(l_shipdate) as y, count(*)::double as n from lineitem group by 1, 2), e as (select unit, max(case when y = 1995 then n end) as a, max(case when y = 1999 then n end) as b from y group by 1)
 select unit, round(pow(b / a, 1.0 / 4) - 1, 6) as rate from e where a > 0 and b > 0""")
def annual_rate(spark: SparkSession, folder: str) -> DataFrame:
    year = lambda y: F.sum((F.year("l_shipdate") == y).cast("double"))
    e = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(year(1995).alias("a"), year(1999).alias("b")).filter("a > 0 and b > 0")
    return e.select("unit", F.round(R.annual_rate(F.col("a"), F.col("b"), F.lit(4.0)), 6).alias("rate"))
