"""What the operators take from the session: tables in the shared folder, bounded batches, and the public vocabularies."""

from __future__ import annotations

from pyspark.sql import SparkSession

from geolattice.session import saved as staged
from geolattice.session import table

__all__ = ["bounded_batches", "partitions", "staged", "table", "vocabulary"]

#: Bytes of a batch that Spark hands to a Python task.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Lets Spark hand Python tasks batches of at most about ``size`` bytes (or one row); a bound that the session has set lower stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(key)) > size:
        spark.conf.set(key, str(size))


def _bytes(value: str) -> int:
    digits = value.lower().rstrip("bkmgt")
    unit = value[len(digits) :].lower().rstrip("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, which is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
