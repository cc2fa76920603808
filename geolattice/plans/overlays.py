"""Queries that lay polygons over polygons: parcels, one for each customer, over sectors, one for each supplier, on a plane that grows with them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.operators import overlay as O
from geolattice.operators import shapes as H
from geolattice.plans.registry import query
from geolattice.session import saved, table
from geolattice.sources.layers import relation_rings

#: Parcels have five corners that overlap their neighbours', every third a hole; sectors tile a part of the plane.
_PARCEL = ["x + k % 5, y + k * 3 % 4", "x + 10 + k % 4, y + k * 7 % 5", "x + 6 + k % 3, y + 5 + k % 2", "x + 11 + k * 5 % 3, y + 10 + k * 11 % 4", "x + k * 13 % 4, y + 9 + k % 6"]
_HOLE = ["x + 4.25, y + 5", "x + 4.25, y + 7", "x + 5.75, y + 7", "x + 5.75, y + 5"]
_CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1)]


def _corner(i: int, j: int) -> str:
    return f"48 * (c + {i}) + ((c + {i}) * 7 + (r + {j}) * 3) % 5, 48 * (r + {j}) + ((c + {i}) * 5 + (r + {j}) * 11) % 6"


def _edges_sql(source: str, key: str, rings: list[list[tuple[str, str]]]) -> str:
    return " union all ".join(
        f"select {key} as poly, {', '.join(f'({v})::double' for v in (*a[0].split(', '), *b[0].split(', ')))} from {source} where {a[1]}" for ring in rings for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)
    )


PLANE = f"""side as (select floor(sqrt(max(c_custkey)))::bigint + 1 as n from customer), pk as (select c_custkey as k, c_custkey % n * 12 as x, c_custkey // n * 12 as y from customer, side), sk as (select s_suppkey as k, s_suppkey % ((n + 3) // 4) as c, s_suppkey // ((n + 3) // 4) as r from supplier, side),
 pe(poly, x0, y0, x1, y1) as ({_edges_sql("pk", "k", [[(p, "true") for p in _PARCEL], [(p, "k % 3 = 0") for p in _HOLE]])}), se(poly, x0, y0, x1, y1) as ({_edges_sql("sk", "k", [[(_corner(*p), "true") for p in _CORNERS]])})"""


def _met_sql(a: str, b: str) -> str:
    """Common areas by signed trapezoids, each edge against each edge of polygons whose boxes meet."""
    piece = lambda e: f"select *, least(x0, x1) as l, greatest(x0, x1) as r, (y1 - y0) / (x1 - x0) as m, sign(x0 - x1) as s from {e} where x0 <> x1"
    box = lambda e: f"select poly, min(x0) as l, max(x0) as r, min(y0) as d, max(y0) as u from {e} group by 1"
    return f"""pairs as (select a.poly as a, b.poly as b, least(a.d, b.d) as base from ({box(a)}) a join ({box(b)}) b on a.l < b.r and b.l < a.r and a.d < b.u and b.d < a.u),
 cross_ as (select pairs.a, pairs.b, greatest(p.l, q.l) as l, least(p.r, q.r) as r, p.s * q.s as s, p.y0 - base - p.x0 * p.m as pc, p.m as pm, q.y0 - base - q.x0 * q.m as qc, q.m as qm from pairs join ({piece(a)}) p on p.poly = pairs.a join ({piece(b)}) q on q.poly = pairs.b where greatest(p.l, q.l) < least(p.r, q.r)),
 ends as (select *, pc + pm * l as pl, pc + pm * r as pr, qc + qm * l as ql, qc + qm * r as qr from cross_), part_ as (select *, (pl - ql) / nullif((pl - ql) - (pr - qr), 0) as t from ends),
 met as (select a, b, sum(s * (r - l) * case when (pl - ql) * (pr - qr) >= 0 then (least(pl, ql) + least(pr, qr)) / 2 else (least(pl, ql) + pl + t * (pr - pl)) / 2 * t + (pl + t * (pr - pl) + least(pr, qr)) / 2 * (1 - t) end) as area from part_ group by 1, 2 having area > 1e-7)"""


MET = f"{PLANE}, {_met_sql('pe', 'se')}, own as (select poly as a, sum(x0 * y1 - x1 * y0) / 2 as own from pe group by 1), split as (select a, b, area, area / own as share from met join own using (a) union all select a, -1, greatest(own - coalesce(i, 0), 0), greatest(own - coalesce(i, 0), 0) / own from own left join (select a, sum(area) as i from met group by 1) using (a))"


def _side(spark: SparkSession, folder: str) -> int:
    return math.isqrt(table(spark, folder, "customer").agg(F.max("c_custkey")).first()[0] or 0) + 1


def _ring(points: list[str]) -> str:
    return "array(" + ", ".join("named_struct('x', cast({} as double), 'y', cast({} as double))".format(*p.split(", ")) for p in points) + ")"


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """(poly, ring, points): a parcel for each customer."""
    n = _side(spark, folder)
    own = table(spark, folder, "customer").selectExpr("c_custkey as k", f"c_custkey % {n} * 12 as x", f"floor(c_custkey / {n}) * 12 as y")
    rings = own.withColumn("rings", F.expr(f"if(k % 3 = 0, array({_ring(_PARCEL)}, {_ring(_HOLE)}), array({_ring(_PARCEL)}))"))
    return rings.select(F.col("k").alias("poly"), F.posexplode("rings").alias("ring", "points"))


def sectors(spark: SparkSession, folder: str) -> DataFrame:
    """(poly, ring, points): a sector for each supplier; sectors don't overlap."""
    n = (_side(spark, folder) + 3) // 4
    own = table(spark, folder, "supplier").selectExpr("s_suppkey as poly", f"s_suppkey % {n} as c", f"floor(s_suppkey / {n}) as r")
    return own.select("poly", F.lit(0).alias("ring"), F.expr(_ring([_corner(*p) for p in _CORNERS])).alias("points"))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    a = O.oriented(parcels(spark, folder))
    return O.shares(a, O.intersection_areas(a, O.oriented(sectors(spark, folder)), 24.0), -1)


@query(f"with {MET} select a as parcel, b as sector, round(area, 6) as area, round(share, 6) as share from split")
def overlay_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Each parcel's area and share in each sector; sector -1 is outside of all."""
    return _split(spark, folder).select(F.col("a").alias("parcel"), F.col("b").alias("sector"), F.round("area", 6).alias("area"), F.round("share", 6).alias("share"))


@query(f"with {MET} select a as parcel, b as sector, round(area, 6) as area from (select *, row_number() over (partition by a order by round(area, 6) desc, b) as k from met) where k = 1")
def largest_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The sector that has most of each parcel; parcels outside all have none."""
    met = O.intersection_areas(O.oriented(parcels(spark, folder)), O.oriented(sectors(spark, folder)), 24.0).withColumn("area", F.round("area", 6))
    return met.groupBy(F.col("a").alias("parcel")).agg(F.min_by(F.struct(F.col("b").alias("sector"), "area"), F.struct(-F.col("area"), F.col("b"))).alias("x")).select("parcel", "x.*")


@query(f"with {MET} select a as parcel, round(area, 6) as area from split where b = -1 and area > 1e-6")
def overlay_difference(spark: SparkSession, folder: str) -> DataFrame:
    """What parcels have outside all sectors."""
    return _split(spark, folder).filter("b = -1 and area > 1e-6").select(F.col("a").alias("parcel"), F.round("area", 6).alias("area"))


@query(f"with {MET} select b as sector, round(sum(share * greatest(c_acctbal, 0)::double), 4) as value, round(sum(area), 4) as area, count(*) as parcels from split join customer on c_custkey = a group by 1")
def value_by_sector(spark: SparkSession, folder: str) -> DataFrame:
    """What parcels hold, given to sectors by area; sector -1 takes the rest."""
    held = table(spark, folder, "customer").select(F.col("c_custkey").alias("a"), F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("v"))
    s = _split(spark, folder).join(held.hint("merge"), "a")
    return s.groupBy(F.col("b").alias("sector")).agg(F.round(F.sum(F.col("share") * F.col("v")), 4).alias("value"), F.round(F.sum("area"), 4).alias("area"), F.count("*").alias("parcels"))


@query(f"with {MET}, parts as (select a, sum(area) as parts from split group by 1) select a as parcel, round(own, 6) as area, abs(parts - own) < 1e-6 as whole, round(own / sum(own) over (), 9) as share from own join parts using (a)")
def totals_check(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of each parcel by sector add up to the parcel."""
    parts = _split(spark, folder).groupBy("a").agg(F.sum("area").alias("parts"))
    own = O.areas(O.oriented(parcels(spark, folder))).withColumnRenamed("poly", "a")
    both = own.join(parts, "a").join(F.broadcast(own.agg(F.sum("area").alias("all"))))
    return both.select(F.col("a").alias("parcel"), F.round("area", 6).alias("area"), (F.abs(F.col("parts") - F.col("area")) < 1e-6).alias("whole"), F.round(F.col("area") / F.col("all"), 9).alias("share"))


#: Hexagons of this side, pointy at the top, cover the plane in rows.
_HEX = 20.0
_HEXES = f"""hk as (select i * 100000 + j as k, i * {_HEX * 3**0.5!r}::double + (j % 2) * {_HEX * 3**0.5 / 2!r}::double as x, j * {_HEX * 1.5!r}::double as y from side, range((side.n * 12 / 30)::bigint + 2) a(i), range((side.n * 12 / 30)::bigint + 3) b(j)),
 he(poly, x0, y0, x1, y1) as (""" + " union all ".join(f"select k, {', '.join(f'{v} + {(_HEX * f(math.radians(60 * a + 30)))!r}::double' for a in (s, s + 1) for v, f in (('x', math.cos), ('y', math.sin)))} from hk" for s in range(6)) + ")"


def hexagons(spark: SparkSession, folder: str) -> DataFrame:
    """(poly, ring, points): hexagons over the plane of the parcels."""
    n = int(_side(spark, folder) * 12 / 30 + 0.5)
    own = spark.range((n + 2) * (n + 3)).selectExpr(f"floor(id / {n + 3}) as i", f"id % {n + 3} as j").selectExpr("i * 100000 + j as poly", f"i * {_HEX * 3**0.5!r}D + j % 2 * {_HEX * 3**0.5 / 2!r}D as x", f"j * {_HEX * 1.5!r}D as y")
    points = [f"x + {_HEX * math.cos(math.radians(60 * k + 30))!r}D, y + {_HEX * math.sin(math.radians(60 * k + 30))!r}D" for k in range(6)]
    return own.select("poly", F.lit(0).alias("ring"), F.expr(_ring(points)).alias("points"))


@query(f"with {PLANE}, {_HEXES}, {_met_sql('pe', 'he')}, own as (select poly as a, sum(x0 * y1 - x1 * y0) / 2 as own from pe group by 1) select b as hex, round(sum(area), 4) as area, round(sum(area / own * greatest(c_acctbal, 0)::double), 4) as value from met join own using (a) join customer on c_custkey = a group by 1")
def hexagon_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """Area and value of parcels in each hexagon, by the share of the parcel that lies there."""
    a = O.oriented(parcels(spark, folder))
    own = O.areas(a).select(F.col("poly").alias("a"), F.col("area").alias("own"))
    held = table(spark, folder, "customer").select(F.col("c_custkey").alias("a"), F.greatest(F.col("c_acctbal").cast("double"), F.lit(0.0)).alias("v"))
    met = O.intersection_areas(a, O.oriented(hexagons(spark, folder)), 24.0).join(own.hint("merge"), "a").join(held.hint("merge"), "a")
    return met.groupBy(F.col("b").alias("hex")).agg(F.round(F.sum("area"), 4).alias("area"), F.round(F.sum(F.col("area") / F.col("own") * F.col("v")), 4).alias("value"))


#: The same arrangement without cells and strips.
_UNION = f"""{PLANE}, own as (select row_number() over () as e, poly % (select n from side) // 6 as g, * from pe), t as (select a.e, a.g, a.poly, a.x0, a.y0, a.x1, a.y1, b.x0 as u0, b.y0 as v0, b.x1 as u1, b.y1 as v1, a.x1 - a.x0 as dx, a.y1 - a.y0 as dy, b.x1 - b.x0 as ex, b.y1 - b.y0 as ey from own a join own b on a.g = b.g and a.poly <> b.poly
 and least(a.x0, a.x1) <= greatest(b.x0, b.x1) and least(b.x0, b.x1) <= greatest(a.x0, a.x1) and least(a.y0, a.y1) <= greatest(b.y0, b.y1) and least(b.y0, b.y1) <= greatest(a.y0, a.y1)),
 c as (select e, ((u0 - x0) * ey - (v0 - y0) * ex) / (dx * ey - dy * ex) as t, ((u0 - x0) * dy - (v0 - y0) * dx) / (dx * ey - dy * ex) as s from t where abs(dx * ey - dy * ex) > 1e-9
  union all select e, ((u0 - x0) * dx + (v0 - y0) * dy) / (dx * dx + dy * dy), 0 from t where abs(dx * ey - dy * ex) <= 1e-9 union all select e, ((u1 - x0) * dx + (v1 - y0) * dy) / (dx * dx + dy * dy), 0 from t where abs(dx * ey - dy * ex) <= 1e-9),
 k as (select distinct e, round(t, 12) as t from c where s between -1e-9 and 1 + 1e-9 and t > 1e-9 and t < 1 - 1e-9 union select e, 0.0 from own union select e, 1.0 from own),
 p as (select own.*, t, lead(t) over (partition by e order by t) as t2 from own join k using (e)),
 q as (select row_number() over () as piece, g, poly, x0 + t * (x1 - x0) as x0, y0 + t * (y1 - y0) as y0, x0 + t2 * (x1 - x0) as x1, y0 + t2 * (y1 - y0) as y1 from p where t2 is not null),
 bx as (select g, poly, min(x0) as l, max(x0) as r, min(y0) as d, max(y0) as u from own group by 1, 2),
 m as (select q.*, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my, bx.poly as other from q join bx on bx.g = q.g and bx.poly <> q.poly and (x0 + x1) / 2 between l - 1e-9 and r + 1e-9 and (y0 + y1) / 2 between d - 1e-9 and u + 1e-9),
 f as (select piece, m.poly, other, sum(((o.y0 > my) <> (o.y1 > my) and mx < (o.x1 - o.x0) * (my - o.y0) / (o.y1 - o.y0) + o.x0)::int) as n,
  bool_or(abs((o.x1 - o.x0) * (my - o.y0) - (o.y1 - o.y0) * (mx - o.x0)) <= 1e-5 and (mx - o.x0) * (mx - o.x1) + (my - o.y0) * (my - o.y1) <= 0) as on_,
  bool_or(abs((o.x1 - o.x0) * (my - o.y0) - (o.y1 - o.y0) * (mx - o.x0)) <= 1e-5 and (mx - o.x0) * (mx - o.x1) + (my - o.y0) * (my - o.y1) <= 0 and (m.x1 - m.x0) * (o.x1 - o.x0) + (m.y1 - m.y0) * (o.y1 - o.y0) > 0) as alike
  from m join own o on o.g = m.g and o.poly = other group by 1, 2, 3),
 gone as (select piece from f where case when on_ then not alike or other < poly else n % 2 = 1 end)"""


@query(f"with {_UNION} select g as name, round(sum(x0 * y1 - x1 * y0) / 2, 4) as area, round(sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))), 4) as outline from q where piece not in (select piece from gone) group by 1")
def dissolved(spark: SparkSession, folder: str) -> DataFrame:
    """Parcels of six columns of the plane as one shape, where overlaps count once: its area and the length of its outline."""
    done = O.dissolve(O.oriented(parcels(spark, folder)), F.floor(F.col("poly") % _side(spark, folder) / 6), 12.0, saved)
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return done.groupBy(F.col("g").alias("name")).agg(F.round(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2, 4).alias("area"), F.round(F.sum(length), 4).alias("outline"))


_POINTS_SQL = " union all ".join(f"select k as poly, {n} as i, ({v.split(', ')[0]})::double as x, ({v.split(', ')[1]})::double as y from pk" for n, v in enumerate(_PARCEL))


@query(f"""with {PLANE}, pp as ({_POINTS_SQL}), dir as (select a.poly, a.i, b.i as j, (b.x - a.x) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) as ux, (b.y - a.y) / sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) as uy, a.x, a.y from pp a join pp b on a.poly = b.poly and a.i <> b.i and (a.x <> b.x or a.y <> b.y)),
 ext as (select dir.poly, dir.i, j, max(pp.x * ux + pp.y * uy) - min(pp.x * ux + pp.y * uy) as a, max(pp.y * ux - pp.x * uy) - min(pp.y * ux - pp.x * uy) as b, min((pp.x - dir.x) * -uy + (pp.y - dir.y) * ux) as side from dir join pp on pp.poly = dir.poly group by 1, 2, 3),
 best as (select poly, least(a, b) as width, greatest(a, b) as length from ext where side >= -1e-9 qualify row_number() over (partition by poly order by round(a * b, 6), least(a, b)) = 1), whole as (select poly, sum(x0 * y1 - x1 * y0) / 2 as area, sum(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2))) as outline from ({_edges_sql("pk", "k", [[(p, "true") for p in _PARCEL]])}) e(poly, x0, y0, x1, y1) group by 1)
 select poly, round(width, 6) as width, round(length, 6) as length, round(length / greatest(width, 1), 5) as elongation, round(area, 6) as area, round(outline, 6) as outline, round(4 * pi() * area / (outline * outline), 6) as compactness from best join whole using (poly)""")
def shape_features(spark: SparkSession, folder: str) -> DataFrame:
    """Width, length, elongation and compactness of each parcel, by the least rectangle around it."""
    done = H.shape_features(parcels(spark, folder))
    return done.select("poly", *[F.round(c, 5 if c == "elongation" else 6).alias(c) for c in done.columns if c != "poly"])


@query(f"with {PLANE} select poly, 1 + (poly % 3 = 0)::int::bigint as rings, round(sum(x0 * y1 - x1 * y0) / 2, 6) as area from pe group by 1")
def assembled_rings(spark: SparkSession, folder: str) -> DataFrame:
    """Parcels as a map service gives them, each ring in two open ways that run alike or against each other, put together again."""
    xy = lambda p: F.transform(p, lambda q: F.struct(q["y"].alias("lat"), q["x"].alias("lon")))
    closed = F.concat("points", F.slice("points", 1, 1))
    half = F.floor(F.size("points") / 2).cast("int") + 1
    second = F.slice(closed, half, F.size(closed) - half + 1)
    member = lambda p: F.struct(F.lit("way").alias("type"), F.when(F.col("ring") > 0, "inner").otherwise("outer").alias("role"), xy(p).alias("geometry"))
    ways = F.array(member(F.slice(closed, 1, half)), member(F.when(F.col("poly") % 2 == 0, F.reverse(second)).otherwise(second)))
    relations = parcels(spark, folder).groupBy("poly").agg(F.flatten(F.collect_list(ways)).alias("members")).select(F.to_json(F.struct(F.array(F.struct(F.lit("relation").alias("type"), F.col("poly").alias("id"), "members")).alias("elements"))).alias("value"))
    found = relation_rings(relations, saved)
    area = F.expr("aggregate(sequence(0, size(points) - 1), 0D, (s, i) -> s + points[i].x * points[(i + 1) % size(points)].y - points[(i + 1) % size(points)].x * points[i].y) / 2")
    return found.groupBy(F.substring_index("poly", "/", -1).cast("long").alias("poly")).agg(F.count("*").alias("rings"), F.round(F.sum(F.when(F.col("hole"), -area).otherwise(area)), 6).alias("area"))
