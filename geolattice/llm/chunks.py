"""Documents dealt once to chunks of bounded size, and questions that chunks ask of each other through keyed exchanges.

Finding what repeats in a corpus needs a second look at the text, with knowledge from everywhere else. The text is
exchanged once, by a hash of its id and itself; the same exchange serves every look, since each look is a branch of one plan (Spark
reuses equal exchanges). In between, chunks send sorted, packed keys to buckets of the key space, and each bucket answers with
one bit a key, in the order in which they were sent, so an answer is far smaller than its question. A key is in one message
of its chunk however often the chunk has it, so a key that a third of all rows share is one entry a chunk.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm.session import partitions

CHUNK_BYTES = 2 << 20
MESSAGE = "bucket long, chunk long, kind int, body binary"
_CODEC = "zstd"


def chunked(docs: DataFrame, doc_id: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(doc_id, text, chunk), exchanged by chunk, and the bytes of text. There are at least as many chunks as shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(-(-total // chunk_bytes), partitions(docs.sparkSession))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("long")).repartition(partitions(docs.sparkSession), "chunk"), total


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes, the bytes of equal weight together, compressed."""
    head, bodies = struct.pack("<I", len(arrays)), []
    for a in arrays:
        kind = a.dtype.str.encode()
        head += struct.pack("<IB", len(a), len(kind)) + kind
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        bodies.append(planes.tobytes())
    raw = head + b"".join(bodies)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, _CODEC, asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    raw = pa.decompress(body[8:], struct.unpack_from("<Q", body)[0], _CODEC, asbytes=True)
    (count,), at, shapes, out = struct.unpack_from("<I", raw), 4, [], []
    for _ in range(count):
        n, k = struct.unpack_from("<IB", raw, at)
        shapes.append((n, np.dtype(raw[at + 5 : at + 5 + k].decode())))
        at += 5 + k
    for n, kind in shapes:
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def deltas(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=sorted_.dtype.type(0))


def messages(rows: Iterable[tuple[int, int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    columns = zip(*rows, strict=True) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "chunk", "kind", "body"])


def ask(chunks: DataFrame, question: Callable[[pa.Table], Iterable[tuple[int, int, int, bytes]]], known: DataFrame | None = None) -> DataFrame:
    """Messages that each chunk sends: question(documents) or, with answers known so far, question(documents, answers)."""
    if known is None:
        return chunks.groupBy("chunk").applyInArrow(lambda t: messages(question(t)), MESSAGE)
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(lambda t, a: messages(question(t, a)) if t.num_rows else messages([]), MESSAGE)


def answer(asked: DataFrame, merge: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """For each bucket and kind, merge(bodies) gives one body for each that came, in the same order; it goes back to where that one came from."""

    def run(t: pa.Table) -> pa.Table:
        replies = merge(t["body"].to_pylist())
        return messages(zip(t["bucket"].to_pylist(), t["chunk"].to_pylist(), t["kind"].to_pylist(), replies, strict=True))

    # messages are small when packed and large at work, so all partitions are wanted
    return asked.repartition(partitions(asked.sparkSession), "kind", "bucket").groupBy("kind", "bucket").applyInArrow(run, MESSAGE)


def replies(answers: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: body for b, k, body in zip(answers["bucket"].to_pylist(), answers["kind"].to_pylist(), answers["body"].to_pylist(), strict=True) if k == kind}


def split(sorted_buckets: np.ndarray) -> list[tuple[int, slice]]:
    """The runs of equal values in a sorted array."""
    if not len(sorted_buckets):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_buckets)) + 1, [len(sorted_buckets)]])
    return [(int(sorted_buckets[a]), slice(int(a), int(b))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sha256_of(parts: list[bytes]) -> list[str]:
    return [hashlib.sha256(p).hexdigest() for p in parts]
