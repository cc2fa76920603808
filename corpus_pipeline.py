"""From raw documents to token ids in five stages, each written as Parquet and read again before the next.

Quality rules drop bad lines and bad documents; of each group of near duplicates the document with the least id stays; benchmark
passages are cut out, and documents made up of them go; personal data are replaced by their kind; what is left becomes piece ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolattice.llm.decontamination import decontaminated
from geolattice.llm.jaccard import one_of_each
from geolattice.llm.pieces import encode_pieces
from geolattice.llm.pii import redacted
from geolattice.llm.quality import kept_documents
from geolattice.llm.session import staged, table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their bad lines; those that fail the rules go. Null and empty texts fail; rows alike fare alike."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id. Null ids and texts without words are in no group and stay."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those mostly made of such go. Null and empty texts stay as they are."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by their kind. Null and empty texts stay as they are."""
    return redacted(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each document. Null and empty texts have no ids."""
    return encode_pieces(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"), keep_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("piece_ids", piece_ids),
]
#: The stages hash, walk automata and boost trees: no SQL says the same.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
