"""Reading vector layers and tables of other kinds as DataFrames: KML, map features in JSON, census and pivot tables in CSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.operators.rings import ranked

_POINTS = "array<struct<lat: double, lon: double>>"
_FEATURES = f"elements array<struct<type: string, id: bigint, tags: map<string, string>, lat: double, lon: double, geometry: {_POINTS}, members: array<struct<role: string, geometry: {_POINTS}>>>>"


def kml_rings(files: DataFrame, xml: str = "value", path: str = "path") -> DataFrame:
    """(path, name, year, poly, ring, points): the outer rings of a KML document's placemarks. year is the first 20xx in the path, or null.

    A placemark may hold several polygons; its rings together are its shape.
    """
    # xpath sees no namespaces, so the default one goes; its path is fixed, so each placemark is looked at by itself
    plain = F.regexp_replace(F.col(xml), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    marks = F.regexp_extract_all(plain, F.lit(r"(?s)<Placemark[ >].*?</Placemark>"), 0)
    found = files.select(path, F.posexplode(marks).alias("n", "__x"))
    shapes = found.withColumns({"name": F.expr("xpath_string(__x, '/Placemark/name')"), "__rings": F.expr("xpath(__x, '//outerBoundaryIs/LinearRing/coordinates/text()')")})
    pair = lambda t: F.struct(F.element_at(F.split(t, ","), 1).cast("double").alias("x"), F.element_at(F.split(t, ","), 2).cast("double").alias("y"))
    points = F.transform(F.split(F.trim("coordinates"), r"\s+"), pair)
    year = F.nullif(F.regexp_extract(path, r"(20\d\d)", 1), F.lit("")).cast("int")
    return shapes.select(path, "name", year.alias("year"), F.concat_ws("/", path, F.col("n").cast("string")).alias("poly"), F.posexplode("__rings").alias("ring", "coordinates")).withColumn("points", points).drop("coordinates")


def map_features(files: DataFrame, json: str = "value") -> DataFrame:
    """(poly, tags, point, ring, points) of the elements of a map service's JSON: nodes are points; closed ways and the outer and inner ways of
    relations are rings, which the even-odd rule turns into shapes with holes. Ways that don't close give no rings."""
    e = files.select(F.explode(F.from_json(json, _FEATURES)["elements"]).alias("e")).select("e.*")
    ways = F.when(F.col("type") == "way", F.array("geometry")).when(F.col("type") == "relation", F.transform(F.filter("members", lambda m: m["role"].isin("outer", "inner")), lambda m: m["geometry"]))
    closed = F.filter(ways, lambda g: (F.size(g) >= 4) & (F.element_at(g, 1) == F.element_at(g, -1)))
    xy = lambda g: F.transform(g, lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    point = F.when(F.col("type") == "node", F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    rows = e.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("poly"), "tags", point.alias("point"), closed.alias("__r"))
    return rows.select("poly", "tags", "point", F.posexplode_outer("__r").alias("ring", "__g")).filter("point is not null or __g is not null").select("poly", "tags", "point", "ring", xy("__g").alias("points"))


def census(spark: SparkSession, path: str, municipality: str | None = None) -> DataFrame:
    """A census table: every column a string, names in upper case without blanks or byte-order mark, rows of one municipality (column MUN)."""
    raw = spark.read.csv(path, header=True)
    out = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip().lstrip("﻿").upper()) for c in raw.columns])
    return out.filter(F.lpad("MUN", 3, "0") == municipality.zfill(3)) if municipality else out


def number(text: str | Column) -> Column:
    """A count of the census: null where it is withheld (``*`` or ``N/D``)."""
    return F.expr(f"try_cast({text} as double)") if isinstance(text, str) else text.try_cast("double")


def pivoted(spark: SparkSession, path: str, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """A long CSV as a matrix of ``rows`` by the ``names`` in ``columns``, sums of ``value``, 0 where there is none."""
    long_ = spark.read.csv(path, header=True, inferSchema=False)
    return long_.groupBy(rows).pivot(columns, names).agg(F.sum(F.col(value).try_cast("double"))).fillna(0.0)


_MEMBERS = f"elements array<struct<type: string, id: bigint, tags: map<string, string>, members: array<struct<type: string, role: string, geometry: {_POINTS}>>>>"


def relation_rings(files: DataFrame, save: Callable[[DataFrame, str], DataFrame], json: str = "value") -> DataFrame:
    """(poly, tags, hole, ring, points) of the relations of a map service's JSON, whose rings may be made of several open ways in any direction.

    Ways of one role (inner, or any other: outer) join where their ends are one point. Each way is two half-edges; at a point, the one
    that arrives goes on with the first to its right, so that half-edges run around faces, and pointer jumping puts each face in order.
    Faces that run counter-clockwise are rings. Where more than two ways meet, their faces are rings of their own, which the even-odd
    rule joins. Ways that end nowhere, and what only leads to such, are left out; so are ways of fewer than two points, and members
    that aren't ways or have no geometry.
    """
    e = files.select(F.explode(F.from_json(json, _MEMBERS)["elements"]).alias("e")).select("e.*").filter("type = 'relation'")
    poly = F.concat_ws("/", "type", F.col("id").cast("string"))
    m = e.select(poly.alias("poly"), "tags", F.explode("members").alias("m")).filter("m.type = 'way' and size(m.geometry) >= 2")
    hole = F.coalesce(F.col("m.role") == "inner", F.lit(False))
    points = F.transform("m.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    ways = save(m.select("poly", "tags", hole.alias("hole"), points.alias("points")).withColumn("way", F.monotonically_increasing_id()), "ways")
    group = ["poly", "hole"]
    ends = ways.select(*group, "way", F.explode(F.array(F.struct(F.element_at("points", 1).alias("at"), F.lit(0).alias("end")), F.struct(F.element_at("points", -1).alias("at"), F.lit(1).alias("end")))).alias("e")).select(*group, "way", "e.*")
    ends = save(ends, "ends")
    while True:  # a point that one end alone has leads nowhere
        loose = ends.groupBy(*group, "at").agg(F.count("*").alias("n"), F.min("way").alias("way")).filter("n = 1").select("way").distinct()
        left = save(ends.join(loose, "way", "left_anti"), "ends")
        if left.count() == ends.count():
            break
        ends = left
    kept = ways.join(left.select("way").distinct(), "way", "left_semi")
    forth = kept.withColumn("side", F.col("way") * 2)
    halves = save(forth.unionByName(forth.withColumns({"side": F.col("way") * 2 + 1, "points": F.reverse("points")})), "half-edges")
    start, second = F.element_at("points", 1), F.element_at("points", 2)
    out = halves.select(*group, "side", start.alias("at"), F.atan2(second["y"] - start["y"], second["x"] - start["x"]).alias("angle"))
    around = Window.partitionBy(*group, "at").orderBy("angle", "side")
    every = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the half-edge to the right of its twin, which leaves where it arrives
    next_ = out.select((F.expr("side ^ 1L")).alias("side"), F.coalesce(F.lag("side").over(around), F.last("side").over(every)).alias("next"))
    faces = save(halves.join(ranked(save(next_, "next"), save), "side"), "faces")
    twice = F.expr("aggregate(sequence(1, size(points) - 1), 0D, (s, i) -> s + points[i - 1].x * points[i].y - points[i].x * points[i - 1].y)")
    inner = faces.groupBy("ring").agg(F.sum(twice).alias("twice")).filter("twice > 0").select("ring")
    parts = faces.join(inner, "ring", "left_semi").select("poly", "hole", "ring", F.struct("pos", F.expr("slice(points, 1, size(points) - 1)").alias("p")).alias("part"))
    whole = parts.groupBy("poly", "hole", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["p"])).alias("points"))  # one ring's ways
    tags = ways.groupBy("poly").agg(F.first("tags").alias("tags"))
    return whole.join(tags, "poly").select("poly", "tags", "hole", "ring", "points")
