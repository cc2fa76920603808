"""Reading scene catalogs and vector layers from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolattice.operators.dates import ZONE, local_day

_BAND = T.StructType([T.StructField(n, T.DoubleType()) for n in ("nodata", "scale", "offset")])
_ASSET = T.StructType([T.StructField("href", T.StringType()), T.StructField("raster:bands", T.ArrayType(_BAND))])
_PROPERTIES = T.StructType([T.StructField(n, t) for n, t in (
    ("datetime", T.StringType()), ("eo:cloud_cover", T.DoubleType()), ("platform", T.StringType()), ("grid:code", T.StringType()),
    ("landsat:wrs_path", T.StringType()), ("landsat:wrs_row", T.StringType()), ("s2:processing_baseline", T.StringType()),
)])
ITEM = T.StructType([T.StructField("id", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("geometry", T.StringType()), T.StructField("properties", _PROPERTIES), T.StructField("assets", T.MapType(T.StringType(), _ASSET))])


def scenes(items: DataFrame, json: str = "value", zone: str = ZONE) -> DataFrame:
    """Scenes from catalog items as JSON strings: scale 1 and offset 0 where an asset states none, tile from the grid code or from path and row."""
    x = items.select(F.from_json(json, ITEM).alias("i")).select("i.id", "i.bbox", F.col("i.properties").alias("p"), "i.assets", "i.geometry")
    tile = F.coalesce(F.regexp_replace(F.col("p")["grid:code"], "^MGRS-", ""), F.concat_ws("/", F.lpad(F.col("p")["landsat:wrs_path"], 3, "0"), F.lpad(F.col("p")["landsat:wrs_row"], 3, "0")))
    band = lambda v: F.element_at(v["raster:bands"], 1)
    assets = F.transform_values("assets", lambda _, v: F.struct(v["href"].alias("href"), F.coalesce(band(v)["scale"], F.lit(1.0)).alias("scale"), F.coalesce(band(v)["offset"], F.lit(0.0)).alias("offset"), band(v)["nodata"].alias("nodata")))
    ts = F.to_timestamp(F.col("p.datetime"))
    return x.select("id", ts.alias("ts"), local_day(ts, zone).alias("day"), F.col("p")["eo:cloud_cover"].alias("cloud"), F.upper("p.platform").alias("platform"), tile.alias("tile"), F.col("p")["s2:processing_baseline"].alias("baseline"), assets.alias("assets"), "bbox", "geometry")


def search(found: DataFrame, bbox: tuple[float, float, float, float], first: str, last: str, max_cloud: float = 100.0, optical: bool = True) -> DataFrame:
    """Scenes of local days from first to last that touch the box; the cloud limit holds for optical ones and under 100 only."""
    b = F.col("bbox")
    touching = (F.element_at(b, 1) <= bbox[2]) & (F.element_at(b, 3) >= bbox[0]) & (F.element_at(b, 2) <= bbox[3]) & (F.element_at(b, 4) >= bbox[1])
    out = found.filter(F.col("day").between(first, last) & touching)
    return out.filter(F.col("cloud") < max_cloud) if optical and max_cloud < 100 else out


def newest_per_tile(found: DataFrame, needed: list[str]) -> DataFrame:
    """Of each day and tile the scene of the newest baseline, of those whose needed assets can all be read over https."""
    readable = found.filter(F.forall(F.array(*[F.lit(n) for n in needed]), lambda n: F.coalesce(F.try_element_at("assets", n)["href"].startswith("https://"), F.lit(False))))
    return readable.groupBy("day", "tile").agg(F.max_by(F.struct(*[c for c in found.columns if c not in ("day", "tile")]), F.struct("baseline", "id")).alias("x")).select("day", "tile", "x.*")


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(poly, ring, points, properties) of a GeoJSON file of polygons and multipolygons; other geometries give no rows. Ids stay as they are, else feature-n."""
    shape = "type string, features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    features = spark.read.schema(shape).json(path, multiLine=True).select(F.posexplode("features").alias("n", "f"))
    return rings(features.select(F.coalesce("f.id", F.col("f.properties")["id"], F.concat(F.lit("feature-"), F.col("n") + 1)).alias("poly"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties")))


def rings(features: DataFrame) -> DataFrame:
    """The rings of features with geometry as (type, coordinates: JSON). Closing points stay; they add an edge without length."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    parse = lambda depth: F.from_json("coordinates", "array<" * depth + "double" + ">" * depth)
    parts = F.when(F.col("type") == "Polygon", parse(3)).when(F.col("type") == "MultiPolygon", F.flatten(parse(4)))
    return features.select("poly", "properties", F.posexplode(parts).alias("ring", "xy")).select("poly", "ring", F.transform("xy", point).alias("points"), "properties")


def box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
