"""The queries of this subpackage, each on its whole table; ``queries`` and ``oracle_sql`` are what the entry file adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm.audit import audit_filters
from geolattice.llm.codes import compress_vectors
from geolattice.llm.decontamination import find_benchmark
from geolattice.llm.jaccard import near_duplicates
from geolattice.llm.minhash import minhash_classes
from geolattice.llm.oracles import AUDIT, CODES, COMPONENTS, DECONTAMINATION, NEAR_DUPLICATES, PASSAGES
from geolattice.llm.pieces import encode_pieces
from geolattice.llm.pii import find_personal_data, listed
from geolattice.llm.quality import clean_lines
from geolattice.llm.session import table, vocabulary
from geolattice.llm.sharding import shard_by_bytes
from geolattice.llm.substrings import drop_repeated_passages
from geolattice.llm.suffixes import drop_repeated_strings
from geolattice.llm.tokenfiles import read_tokens, write_tokens
from geolattice.llm.toxicity import score_toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=8)
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_bad_lines", "n_lost_words")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.sha2(listed(F.col("base_spans")).cast("binary"), 256)
    return done.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", base.alias("base_sha256"), listed(F.col("all_spans")).alias("spans"), "n_added")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_pieces(docs, vocabulary("piece_bpe_32k.model"), digest=True)
    return done.select("doc_id", "n_tokens", "ids_crc32", "lossless")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_strings(table(spark, sf_dir, "documents")).drop("kept")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_sharding, op3_quality, op4_pii, op5_decontamination, op6_pieces, op7_substrings, op8_suffixes, op9_jaccard, op10_tokenfiles, op11_audit, op12_codes, op13_minhash)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others hash, sort bytes, draw or learn; tests hold them against plain versions."""
    return {"op5_decontamination": DECONTAMINATION, "op7_substrings": PASSAGES, "op9_jaccard": NEAR_DUPLICATES, "op11_audit": AUDIT, "op12_codes": CODES, "op13_minhash": COMPONENTS}
