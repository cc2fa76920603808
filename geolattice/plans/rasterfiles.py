"""Queries on raster files: scenes written as GeoTIFF and read again by windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.operators.grid import Grid
from geolattice.plans.fixtures import BANDS, PIXELS, SIDE, pixels, side
from geolattice.plans.registry import query
from geolattice.session import shared_folder
from geolattice.sources import geotiff

_LONG = f"{PIXELS}, lg as (" + " union all ".join(f"select scene::bigint as scene, '{b}' as band, r, c, {b} as v from px" for b in BANDS) + ")"
_WINDOW = f"r >= {SIDE} // 4 and r < {SIDE} * 3 // 4 and c >= {SIDE} // 8 and c < {SIDE} // 2"


@query(f"with {_LONG} select scene, band, count(v) as cells, round(sum(v), 6) as total, round(max(v), 6) as most from lg where {_WINDOW} and v is not null group by 1, 2")
def window_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each scene as a file with four bands; the middle rows and the columns left of the middle are read again, by the tiles they touch."""
    n = side(spark, folder)
    where = f"{shared_folder(spark).rstrip('/')}/geolattice/scenes-{uuid.uuid4().hex}"
    geotiff.write(pixels(spark, folder), where, Grid(0.0, 0.0, float(n), float(n), n, n), list(BANDS), name="scene", epsg=32613, dtype="float64", side=16 * max(1, n // 256))
    window = geotiff.read(spark, where).filter(F.col("r").between(n // 4, n * 3 // 4 - 1) & F.col("c").between(n // 8, n // 2 - 1) & F.col("dn").isNotNull())
    scene = F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("scene")
    band = F.element_at(F.array(*[F.lit(b) for b in BANDS]), F.col("band")).alias("band")
    return window.groupBy(scene, band).agg(F.count("*").alias("cells"), F.round(F.sum("dn"), 6).alias("total"), F.round(F.max("dn"), 6).alias("most"))
