"""Queries on access and shapes: lattices, networks, outlines, fused and cleaned zones, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.operators import network as N
from geolattice.operators import pixels as P
from geolattice.operators import quadtree as Q
from geolattice.operators import spans as M
from geolattice.operators import territory as T
from geolattice.operators import units as U
from geolattice.operators.zones import clean_mask, label, outlines
from geolattice.plans.fixtures import PIXELS, SCENES, pixels, scenes, side
from geolattice.plans.iterative import STREETS, network_distance, street_grid, street_side
from geolattice.plans.raster import _zones_sql
from geolattice.plans.registry import query
from geolattice.plans.units import _PLACES, _points
from geolattice.session import saved, table

_EIGHT = _zones_sql("abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1", 1).rsplit("select zone, count(*)", 1)[0]


def _changed(spark: SparkSession, folder: str) -> DataFrame:
    return P.construction(pixels(spark, folder), 1995, 1996).filter("state <> 'none'")


_NETWORK = f"""{STREETS}, walk(node, d) using key (node) as (select s_suppkey * 4, min(0.0::double) from supplier group by 1 union select e.dst, min(walk.d + e.w) from walk join e on e.src = walk.node left join recurring.walk as known on known.node = e.dst where known.d is null or walk.d + e.w < known.d group by 1),
 nodes as (select i as node, i % n * 40.0 as nx, i // n * 40.0 as ny from side, range(side.n * side.n) t(i)), o as (select c_custkey as id, (c_custkey * 7919 % 10007) / 10.0 as x, (c_custkey * 104729 % 10009) / 10.0 as y, c_custkey % 9 as pop from customer),
 near as (select id, node, d from (select id, node, sqrt(pow(x - nx, 2) + pow(y - ny, 2)) as d, row_number() over (partition by id order by round(sqrt(pow(x - nx, 2) + pow(y - ny, 2)), 9), node) as k from o, nodes) where k = 1),
 access as (select o.id, o.pop, case when o.id % 10 = 0 then 0 else near.d + walk.d end as d from o left join near using (id) left join walk using (node))"""


def street_nodes(spark: SparkSession, folder: str) -> DataFrame:
    side = street_side(spark, folder)
    return spark.range(side * side).select(F.col("id").alias("node"), (F.col("id") % side * 40.0).alias("x"), (F.floor(F.col("id") / side) * 40.0).alias("y"))


def _access(spark: SparkSession, folder: str) -> DataFrame:
    return N.access(_points(spark, folder).withColumn("inside", F.col("id") % 10 == 0), street_nodes(spark, folder), network_distance(spark, folder), saved)


@query(f"with recursive {_NETWORK} select id, round(d, 6) as d from access")
def network_access(spark: SparkSession, folder: str) -> DataFrame:
    """From each origin the straight way to its nearest node, however far, and on over the network; 0 for origins inside a place."""
    return _access(spark, folder).select("id", F.round("d", 6).alias("d"))


@query(f"with recursive {_NETWORK} select cut::bigint as cut, round(sum(case when d <= cut then pop else 0 end) / sum(pop), 6) as share from access, (values (50), (100), (150), (200), (400), (800)) t(cut) group by 1")
def access_share(spark: SparkSession, folder: str) -> DataFrame:
    """The share of people within each network distance."""
    people = _access(spark, folder).join(_points(spark, folder).select("id", "pop"), "id")
    return T.access_curve(people, "d", "pop", [50, 100, 150, 200, 400, 800]).withColumn("share", F.round("share", 6))


#: Parks are squares of 5 to 34 m half width over the streets.
_PARKS = """pks as (select s_suppkey as place, s_suppkey * 7907 % 10007 / 10007.0::double * n * 40 as px, s_suppkey * 6101 % 10009 / 10009.0::double * n * 40 as py, 5.0::double + s_suppkey % 30 as h from supplier, side),
 dist as (select place, node, greatest(abs(nx - px) - h, 0) as ox, greatest(abs(ny - py) - h, 0) as oy, abs(nx - px) <= h and abs(ny - py) <= h as inside from pks, nodes where abs(nx - px) <= h + 150 and abs(ny - py) <= h + 150),
 ent as (select place, node, d from (select *, row_number() over (partition by place order by d, node) as k from (select place, node, case when inside then 0 else sqrt(ox * ox + oy * oy) end as d from dist)) where d <= 20 or k = 1 and d <= 150)"""
_STREET_NODES = f"{STREETS}, nodes as (select i as node, i % n * 40.0::double as nx, i // n * 40.0::double as ny from side, range(side.n * side.n) t(i)), {_PARKS}"


def parks(spark: SparkSession, folder: str) -> DataFrame:
    """Edges (place, x0, y0, x1, y1) of a square park for each supplier."""
    m = street_side(spark, folder) * 40
    own = table(spark, folder, "supplier").selectExpr("s_suppkey as place", f"s_suppkey * 7907 % 10007 / 10007D * {m} as px", f"s_suppkey * 6101 % 10009 / 10009D * {m} as py", "5D + s_suppkey % 30 as h")
    at = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    sides = F.array(*[F.struct(*[(F.col(v) + F.col("h") * k).alias(n) for v, k, n in (("px", a[0], "x0"), ("py", a[1], "y0"), ("px", b[0], "x1"), ("py", b[1], "y1"))]) for a, b in zip(at, at[1:] + at[:1], strict=True)])
    return own.select("place", F.explode(sides).alias("e")).select("place", "e.*")


@query(f"with {_STREET_NODES} select place, node, round(d, 6) as d from ent")
def park_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Street nodes from which each park is entered: all within 20 m, or else the nearest up to 150 m."""
    return N.entries(street_nodes(spark, folder), parks(spark, folder)).select("place", "node", F.round("d", 6).alias("d"))


@query(f"""with recursive {_STREET_NODES}, walk(place, node, d) using key (place, node) as (select place, node, d from ent union select walk.place, e.dst, min(walk.d + e.w) from walk join e on e.src = walk.node left join recurring.walk as known on known.place = walk.place and known.node = e.dst where known.d is null or walk.d + e.w < known.d group by 1, 2),
 o as (select c_custkey as id, c_custkey * 7919 % 10007 / 10007.0::double * n * 40 as x, c_custkey * 104729 % 10009 / 10009.0::double * n * 40 as y from customer, side),
 near as (select id, node, d from (select id, node, sqrt(pow(x - nx, 2) + pow(y - ny, 2)) as d, row_number() over (partition by id order by round(sqrt(pow(x - nx, 2) + pow(y - ny, 2)), 9), node) as k from o, nodes) where k = 1),
 m as (select id, place, case when abs(x - px) < h and abs(y - py) < h then 0 else near.d + walk.d end as d from near join walk using (node) join o using (id) join pks using (place))
 select id, count(*) as reached, round(min(d), 4) as nearest, count(*) filter (where d <= 400)::bigint as within_400, round(sum(d), 2) as total from m group by 1""")
def park_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The matrix of origins and parks, summed up for each origin: parks reached, the nearest, those within 400 m, and all distances."""
    m = street_side(spark, folder) * 40
    origins = table(spark, folder, "customer").selectExpr("c_custkey as id", f"c_custkey * 7919 % 10007 / 10007D * {m} as x", f"c_custkey * 104729 % 10009 / 10009D * {m} as y")
    d = N.matrix(street_grid(spark, street_side(spark, folder)), street_nodes(spark, folder), parks(spark, folder), origins, saved)
    return d.groupBy("id").agg(F.count("*").alias("reached"), F.round(F.min("d"), 4).alias("nearest"), F.count_if(F.col("d") <= 400).alias("within_400"), F.round(F.sum("d"), 2).alias("total"))


@query(f"with {_PLACES}, n as (select id, place, sqrt((x - px) * (x - px) + (y - py) * (y - py)) as d from p, q), k as (select *, row_number() over (partition by id order by d, place) as k from n) select id, place, round(d, 6) as d from k where k = 1")
def nearest_anywhere(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest place of every point, however far."""
    places = table(spark, folder, "supplier").selectExpr("s_suppkey as place", "(s_suppkey * 7907 % 10007) / 10.0D as px", "(s_suppkey * 6101 % 10009) / 10.0D as py")
    return Q.nearest_place(_points(spark, folder), places, saved).withColumn("d", F.round("d", 6))


@query(f"with {PIXELS}, u as (select s_suppkey as id, (s_suppkey * 37 % 300) / 10.0 + 0.6 as x, (s_suppkey * 91 % 300) / 10.0 + 0.6 as y, s_suppkey % 4 * 0.55 as h from supplier), v as (select r, c, red from px where scene = 1996 and red > 0), m as (select id, median(red) as m, count(*) as n from u join v on c + 0.5 >= x - h and c + 0.5 < x + h and r + 0.5 >= y - h and r + 0.5 < y + h group by 1) select u.id, round(coalesce(m, red), 6) as value, coalesce(n, 0) as n from u left join m using (id) left join v on v.r = floor(u.y) and v.c = floor(u.x)")
def zonal_median_or_centre(spark: SparkSession, folder: str) -> DataFrame:
    """Median over the land cells of small squares; one that holds no cell centre takes the cell it lies in."""
    u = table(spark, folder, "supplier").selectExpr("s_suppkey as id", "(s_suppkey * 37 % 300) / 10.0D + 0.6D as x", "(s_suppkey * 91 % 300) / 10.0D + 0.6D as y", "s_suppkey % 4 * 0.55D as h")
    v = pixels(spark, folder).filter("scene = 1996 and red > 0").select("r", "c", "red")
    span = lambda a: F.sequence(F.ceil(F.col(a) - F.col("h") - 0.5), F.ceil(F.col(a) + F.col("h") - 0.5) - 1)
    some = u.filter("ceil(x - h - 0.5) < ceil(x + h - 0.5) and ceil(y - h - 0.5) < ceil(y + h - 0.5)")
    cells = some.select("id", F.explode(span("y")).alias("r"), "x", "h").select("id", "r", F.explode(span("x")).alias("c"))
    m = cells.join(v, ["r", "c"]).groupBy("id").agg(F.median("red").alias("m"), F.count("*").alias("n"))
    centre = u.select("id", F.floor("y").alias("r"), F.floor("x").alias("c")).join(v, ["r", "c"], "left").select("id", "red")
    return centre.join(m, "id", "left").select("id", F.round(F.coalesce("m", "red"), 6).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"{_EIGHT}, k as (select own.r, own.c, z.zone from own join z on own.id = z.x), s as (select zone, r, c, r + dr as nr, c + dc as nc from k, (values (0, 1), (1, 0), (0, -1), (-1, 0)) d(dr, dc)) select zone, count(*) as sides from s where (nr, nc, zone) not in (select (r, c, zone) from k) group by 1")
def zone_outlines(spark: SparkSession, folder: str) -> DataFrame:
    """Zones as outlines: the sides of their cells without a cell of the zone behind them."""
    return outlines(label(_changed(spark, folder), saved)).groupBy("zone").agg(F.count("*").alias("sides"))


_FUSED = f"""{_STREET_NODES}, pc as (select place, r, unnest(range(ceil(px - h - 0.5)::bigint, ceil(px + h - 0.5)::bigint)) as c from (select *, unnest(range(ceil(py - h - 0.5)::bigint, ceil(py + h - 0.5)::bigint)) as r from pks)),
 disc as (select a as dr, b as dc from range(-3, 4) x(a), range(-3, 4) y(b) where a * a + b * b <= 9), gr as (select distinct r + dr as r, c + dc as c from (select distinct r, c from pc), disc),
 sh as (select g.r, g.c from gr g join disc on true join gr o on o.r = g.r + dr and o.c = g.c + dc group by 1, 2 having count(*) = 29),
 rn as (select row_number() over (order by r, min(c)) as run, r, min(c) as c0, max(c) as c1 from (select r, c, c - row_number() over (partition by r order by c) as k from sh) group by r, k),
 ed as (select a.run as a, b.run as b from rn a join rn b on abs(a.r - b.r) = 1 and a.c0 <= b.c1 and b.c0 <= a.c1),
 lab(run, z) using key (run) as (select run, min(run) from rn group by 1 union select ed.b, min(lab.z) from lab join ed on ed.a = lab.run join recurring.lab as known on known.run = ed.b where lab.z < known.z group by 1),
 size as (select place, count(*) as cells, min((r, c)) as first from pc group by 1), zp as (select place, size.cells, z from size join rn on rn.r = first[1] and first[2] between c0 and c1 join lab using (run)),
 zs as (select z, sum(c1 - c0 + 1)::bigint as area from rn join lab using (run) group by 1), zn as (select z, arg_max(place, cells * 1000000 - place) as name from zp group by 1)"""


@query(f"with recursive {_FUSED} select place as part, name as fused, zp.cells, area from zp join zn using (z) join zs using (z)")
def fused_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Parks that touch when each grows by 3 m are one, which shrinks back to its outline; the largest gives the name."""
    edges = parks(spark, folder).withColumnRenamed("place", "poly")
    of, zones = M.fused(M.of_polygons(edges).withColumnRenamed("poly", "part"), "part", 3, saved)
    return of.join(zones.select("zone", F.col("name").alias("fused"), F.col("cells").alias("area")), "zone").select("part", "fused", "cells", "area")


@query()
def cleaned_mask(spark: SparkSession, folder: str) -> DataFrame:
    """Small zones dropped, small holes filled, the edge smoothed."""
    cells = pixels(spark, folder).filter("scene = 1996 and nir > red").select("r", "c")
    return clean_mask(cells, side(spark, folder), side(spark, folder), saved, least=4, hole=12).select("r", "c")


@query(f"{_EIGHT}, s as (select zone, count(*) as cells from z group by 1), k as (select *, row_number() over (order by cells desc, zone) as k from s) select '{{\"zones\":' || (select count(*) from s) || ',\"cells\":' || (select sum(cells) from s) || ',\"largest\":[' || string_agg('{{\"zone\":' || zone || ',\"cells\":' || cells || '}}', ',' order by k) || ']}}' as json from k where k <= 5")
def weekly_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a week as JSON: zones, cells and the five largest."""
    s = label(_changed(spark, folder), saved).groupBy("zone").agg(F.count("*").alias("cells"))
    top = s.orderBy(F.desc("cells"), "zone").limit(5).agg(F.array_sort(F.collect_list(F.struct(-F.col("cells"), "zone", "cells"))).alias("l"))
    all_ = s.agg(F.count("*").alias("zones"), F.sum("cells").alias("cells")).join(F.broadcast(top))
    return all_.select(F.to_json(F.struct("zones", "cells", F.transform("l", lambda x: F.struct(x["zone"].alias("zone"), x["cells"].alias("cells"))).alias("largest"))).alias("json"))


@query(f"with {_PLACES}, n as (select place, count(id) as public from q left join p on id % 3 <> 0 and sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 20 group by 1), s as (select place, count(id) as private from q left join p on id % 3 = 0 and sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 60 group by 1) select place from n join s using (place) where public = 0 and private > 0")
def gated_units(spark: SparkSession, folder: str) -> DataFrame:
    """Units with a private street and no public node within 20 m."""
    places = table(spark, folder, "supplier").selectExpr("s_suppkey as place", "(s_suppkey * 7907 % 10007) / 10.0D as px", "(s_suppkey * 6101 % 10009) / 10.0D as py")
    p = _points(spark, folder)
    private = U.within_radius(p.filter("id % 3 = 0"), places, 60.0, "pop").filter("n > 0").select("place")
    public = U.within_radius(p.filter("id % 3 <> 0"), places, 20.0, "pop").filter("n > 0").select("place")
    return private.join(public, "place", "left_anti")


@query("with g as (select l_partkey % 40 // 10 * 4 + l_suppkey % 40 // 10 as sector, year(l_shipdate)::bigint as y, sum(l_quantity)::double * 40 as m2 from lineitem group by 1, 2) select sector::bigint as sector, y, round(sum(m2) over (partition by sector order by y), 4) as built, round(sum(m2) over (partition by sector order by y) / 1000000, 6) as share from g")
def built_by_sector(spark: SparkSession, folder: str) -> DataFrame:
    sector = F.floor(F.col("l_partkey") % 40 / 10) * 4 + F.floor(F.col("l_suppkey") % 40 / 10)
    g = table(spark, folder, "lineitem").groupBy(sector.alias("sector"), F.year("l_shipdate").cast("long").alias("y")).agg((F.sum("l_quantity").cast("double") * 40).alias("m2"))
    built = T.running_total(g, ["sector"], "y", "m2")
    return built.select("sector", "y", F.round("total", 4).alias("built"), F.round(F.col("total") / 1000000, 6).alias("share"))


@query(f"with {SCENES}, s as (select strftime(day, '%Y-%m') as month, min(cloud) as cloud from sc where tile = 0 group by 1), f as (select strftime(day, '%Y-%m') as month, min(cloud) as cloud from sc group by 1) select month, s.cloud as stored, f.cloud as found from f left join s using (month) where s.cloud is distinct from f.cloud")
def history_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Months whose stored value isn't what a fresh look finds."""
    month = F.date_format("day", "yyyy-MM").alias("month")
    s = scenes(spark, folder)
    stored = s.filter("tile = 0").groupBy(month).agg(F.min("cloud").alias("stored"))
    found = s.groupBy(month).agg(F.min("cloud").alias("found"))
    return found.join(stored, "month", "left").filter(~F.col("stored").eqNullSafe(F.col("found"))).select("month", "stored", "found")
