"""Tables that cut lineage: written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, and in local mode only, a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="geolattice-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/geolattice/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
