"""Vector code compression: each part of a vector becomes the index of its codebook's nearest entry, in whole numbers throughout.

Segment-mean lower bounds look at few entries in full: the means of blocks of a part, and the norms of what the means leave, bound a
distance from below, first for the whole part, then for ever shorter blocks. What the bounds can't exclude gets its exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm.session import bounded_batches, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components from here on count as not finite: squared distances would leave 64 bits.
TOO_LARGE = float(1 << 20)
#: Rows that a task codes at a time.
ROWS = 2048
#: Labels up to which their sums are broadcast.
BROADCAST_LABELS = 200_000
#: Bounds are floats of some 16 digits; so much is taken off, and one.
SLACK = 1e-9


def whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def _levels(width: int) -> list[int]:
    """Numbers of blocks of a part, coarse to fine: 1, 2, 4 and so on while they divide it, without single components."""
    out = [1]
    while out[-1] * 2 < width and width % (out[-1] * 2) == 0:
        out.append(out[-1] * 2)
    return out


def _sketch(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of the blocks of each row, and the norms of the residuals."""
    cut = x.reshape(len(x), blocks, -1).astype(np.float64)
    mean = cut.mean(axis=2)
    return mean, np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=(1, 2)))


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the entry of ``book`` nearest to each row of ``x`` (squared Euclidean distance, ties to the lower index), and the distance."""
    n, width = x.shape
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = lambda i, k: ((x[i] - book[k]) ** 2).sum(axis=1)
    row = entry = limit = None
    for blocks in _levels(width):
        (mx, rx), (mb, rb) = _sketch(x, blocks), _sketch(book, blocks)
        size = width // blocks
        if row is None:
            bound = size * (mx - mb.T) ** 2 + (rx[:, None] - rb[None]) ** 2
            guess = bound.argmin(axis=1)
            limit = exact(np.arange(n), guess)
            row, entry = np.nonzero(bound * (1 - SLACK) - 1 <= limit[:, None])
        else:
            bound = size * ((mx[row] - mb[entry]) ** 2).sum(axis=1) + (rx[row] - rb[entry]) ** 2
            left = bound * (1 - SLACK) - 1 <= limit[row]
            row, entry = row[left], entry[left]
    d = exact(row, entry)
    # pairs stand by row, then entry, and each row has the entry that gave its limit
    begin = np.searchsorted(row, np.arange(n))
    least = np.minimum.reduceat(d, begin)
    first = np.flatnonzero(d == least[row])
    _, at = np.unique(row[first], return_index=True)
    return entry[first[at]], least


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            some = batch.slice(first, ROWS)
            yield some, whole_numbers(some.column("embedding").flatten().to_numpy(zero_copy_only=False)).reshape(some.num_rows, PARTS, width)


def _gathered(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, x in _rows(batches, width):
            for p in range(parts):
                at, _ = nearest_entries(x[:, p], books[p])
                np.add.at(total[p], at, x[:, p])
                count[p] += np.bincount(at, minlength=entries)
        p, k = np.nonzero(count)
        sums = pa.array(total[p, k].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(k.astype(np.int32)), sums, pa.array(count[p, k])], names=["part", "entry", "sums", "n"])

    return run


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, x in _rows(batches, books.shape[2]):
            found = [nearest_entries(x[:, p], books[p]) for p in range(PARTS)]
            at, error = np.stack([f[0] for f in found], axis=1).astype(np.uint8), sum(f[1] for f in found)
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array([r.tobytes().hex() for r in at], pa.string()), pa.array(error, pa.int64()), some.column("label")], names=["vec_id", "code", "error", "label"])

    return run


def fit_codebooks(vectors: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """books[part, entry, component] of (vec_id, embedding) rows that are all of PARTS * ``width`` components.

    The first entries are the parts of the rows with the ENTRIES smallest ids (rows of one id by their components); each round
    gathers for each entry the sum and the number of the parts next to it, ENTRIES * PARTS rows at most, whatever the number of vectors.
    """
    first = vectors.filter("vec_id is not null").orderBy("vec_id", "embedding").limit(ENTRIES).collect()
    if not first:
        return np.zeros((PARTS, 0, width), np.int64)
    books = whole_numbers(np.array([r["embedding"] for r in first], np.float64).reshape(-1, PARTS, width)).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        found = vectors.select("embedding").mapInArrow(_gathered(books), "part int, entry int, sums array<long>, n long")
        sums = found.groupBy("part", "entry").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)], F.sum("n").alias("n"))
        for r in sums.collect():
            books[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that is kept.

    Left out are null and empty vectors, those with null or non-finite components (from TOO_LARGE on, a component counts as such), and
    those whose length isn't a multiple of PARTS or isn't that of the kept vector with the least id. A null id is coded like any, but gives
    no first entry; if there are only such, nothing can be coded and nothing is returned. Rows alike are coded alike, each with a row of
    its own. With fewer than ENTRIES rows there are as many entries. label_error sums the errors of equal labels, null ones together.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    own = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    fine = F.forall("embedding", lambda x: F.coalesce((x > -TOO_LARGE) & (x < TOO_LARGE), F.lit(False)))  # NaN is above all
    own = own.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0) & fine)
    first = own.filter("vec_id is not null").orderBy("vec_id", "embedding").select(F.size("embedding")).first()
    length = first[0] if first else -1
    own = own.filter(F.size("embedding") == length)
    books = fit_codebooks(own, max(length, 0) // PARTS)
    kind = own.schema["label"].dataType.simpleString()
    coded = staged(own.mapInArrow(_coded(books), f"vec_id long, code string, error long, label {kind}"), "codes")
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    named = sums.withColumnRenamed("label", "__label")
    return coded.join(named, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
