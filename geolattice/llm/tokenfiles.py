"""Token ids in binary files: patched frame-of-reference blocks with an index of where each begins.

A file is the payload of one row of a Parquet table, so Spark's committer makes it whole or not at all, on any store. Layout,
little-endian: b"PFR1", then unsigned 64-bit counts of ids, documents and blocks; for each block the 64-bit place of its first
byte behind the index; for each document its 64-bit id (signed), whether it has one (a byte each), and its 32-bit count of ids;
then the blocks. A block holds up to BLOCK ids: the 32-bit minimum, 16-bit count of ids, 8-bit width and 16-bit count of
exceptions, the differences to the minimum packed at that width (lowest bits first), then exceptions as 16-bit places and
32-bit differences. The width is that which a share PERCENTILE of the differences need.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.llm import text as T
from geolattice.llm.session import bounded_batches, partitions, staged
from geolattice.llm.wordcache import WordCache

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MAGIC, BLOCK, PERCENTILE = b"PFR1", 1024, 0.99
#: Bytes of text in a file.
FILE_BYTES = 8 << 20
#: A file's row: the range of ids that it is in, its place there, the ids of that range before it, what it holds, and its bytes.
FILES = "part int, file int, before long, n_ids long, n_docs long, payload binary"
#: Parts up to which the table of their first ids is broadcast (16 bytes each).
MAX_PARTS = 200_000
#: Stretches of text whose ids a worker keeps.
STRETCHES = 1_000_000
#: Bytes of text encoded at a time.
ENCODED = 1 << 20
#: Words in a text that the tokenizer gets, and such texts at a time: in longer ones each word costs it more.
LINES = 64
_HEAD = np.dtype([("least", "<u4"), ("n", "<u2"), ("width", "u1"), ("n_out", "<u2")])


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _holder(width: int) -> np.dtype:
    """The numbers of 16 or 32 bits that hold ``width`` bits."""
    return np.dtype("<u2" if width <= 16 else "<u4")


def write_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of a file and the place of each."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.uint64)
    padded = np.concatenate([ids.astype(np.uint32), np.full(n * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n, BLOCK)
    least = padded.min(axis=1)
    over = padded - least[:, None]
    place = int(PERCENTILE * (BLOCK - 1))
    width = _widths(np.partition(over, place, axis=1)[:, place])
    counts = np.full(n, BLOCK)
    counts[-1] = len(ids) - (n - 1) * BLOCK
    out: list[bytes] = [b""] * n
    for w in np.unique(width):  # blocks of one width are packed together
        rows = np.flatnonzero(width == w)
        part = over[rows]
        most = (1 << int(w)) - 1
        outside = part > most
        kind = _holder(int(w))
        low = (part & np.uint32(most)).astype(kind)
        bits = np.unpackbits(low.view(np.uint8).reshape(len(rows), BLOCK, kind.itemsize), axis=2, bitorder="little")[:, :, : int(w)]
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for k, r in enumerate(rows.tolist()):
            at = np.flatnonzero(outside[k, : counts[r]])
            head = np.array([(least[r], counts[r], w, len(at))], _HEAD).tobytes()
            out[r] = head + packed[k, : -(-int(counts[r]) * int(w) // 8)].tobytes() + at.astype("<u2").tobytes() + part[k, at].astype("<u4").tobytes()
    sizes = np.array([len(b) for b in out])
    return b"".join(out), (np.cumsum(sizes) - sizes).astype("<u8")


def read_blocks(body: bytes, index: np.ndarray) -> np.ndarray:
    """The ids of all blocks; blocks of one width are unpacked together."""
    n = len(index)
    if not n:
        return np.zeros(0, np.uint32)
    raw, at = np.frombuffer(body, np.uint8), index.astype(np.int64)
    head = raw[at[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD).ravel()
    counts = head["n"].astype(np.int64)
    out = np.zeros((n, BLOCK), np.int64)
    size = -(-counts * head["width"].astype(np.int64) // 8)
    for w, c in {(int(a), int(b)) for a, b in zip(head["width"], counts, strict=True)}:
        rows = np.flatnonzero((head["width"] == w) & (counts == c))
        if w:
            packed = raw[(at[rows] + _HEAD.itemsize)[:, None] + np.arange(size[rows[0]])]
            # each value is in the few bytes from that of its first bit on
            bit = w * np.arange(c)
            value = np.zeros((len(rows), c), np.uint64 if w > 25 else np.uint32)
            for k in range(-(-(w + 7) // 8)):
                value |= packed[:, np.minimum((bit >> 3) + k, packed.shape[1] - 1)].astype(value.dtype) << value.dtype.type(8 * k)
            out[rows, :c] = (value >> (bit & 7).astype(value.dtype)) & value.dtype.type((1 << w) - 1)
    for r in np.flatnonzero(head["n_out"]).tolist():
        k, p = int(head["n_out"][r]), int(at[r]) + _HEAD.itemsize + int(size[r])
        out[r, np.frombuffer(body, "<u2", k, p)] = np.frombuffer(body, "<u4", k, p + 2 * k)
    out += head["least"].astype(np.int64)[:, None]
    return out.ravel()[np.arange(BLOCK)[None, :].repeat(n, 0).ravel() < counts.repeat(BLOCK)].astype(np.uint32)


def write_file(ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray) -> bytes:
    body, index = write_blocks(ids)
    docs = np.array([x or 0 for x in doc_ids], "<i8")
    return MAGIC + struct.pack("<QQQ", len(ids), len(docs), len(index)) + index.tobytes() + docs.tobytes() + bytes(x is not None for x in doc_ids) + sizes.astype("<u4").tobytes() + body


def read_file(payload: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, document ids, count of each document's ids)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a file of token ids")
    _, n_docs, n_blocks = struct.unpack_from("<QQQ", payload, 4)
    at = 28
    index = np.frombuffer(payload, "<u8", n_blocks, at)
    docs = np.frombuffer(payload, "<i8", n_docs, at := at + 8 * n_blocks)
    has = np.frombuffer(payload, np.uint8, n_docs, at := at + 8 * n_docs)
    sizes = np.frombuffer(payload, "<u4", n_docs, at := at + n_docs).astype(np.int64)
    ids = read_blocks(payload[at + 4 * n_docs :], index)
    return ids, [x if h else None for x, h in zip(docs.tolist(), has.tolist(), strict=True)], sizes


#: White space of ASCII beyond the blank and the line feed, and of Unicode in UTF-8 (first two bytes, then the third ones).
_ASCII_SPACE = np.isin(np.arange(256), [9, 11, 12, 13, 28, 29, 30, 31])
_WIDE_SPACE = {(0xC2, 0x85): None, (0xC2, 0xA0): None, (0xE1, 0x9A): [0x80], (0xE2, 0x80): [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF], (0xE2, 0x81): [0x9F], (0xE3, 0x80): [0x80]}


def _odd(s: T.Slice) -> np.ndarray:
    """Documents with other white space than single blanks and line feeds between words, or with "<|", which may begin a special token."""
    x = s.data
    gap = (x == 32) | (x == 10)
    bad = _ASCII_SPACE[x]
    bad[1:] |= gap[1:] & gap[:-1] | (x[1:] == 124) & (x[:-1] == 60)
    edge = np.concatenate([s.offsets[:-1], s.offsets[1:] - 1])[np.tile(np.diff(s.offsets) > 0, 2)]
    bad[edge] |= gap[edge]
    for (a, b), thirds in _WIDE_SPACE.items():
        at = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
        if thirds is not None:
            at = at[at + 2 < len(x)]
            at = at[np.isin(x[at + 2], thirds)]
        bad[at] = True
    out = np.zeros(s.n, bool)
    out[np.searchsorted(s.offsets[1:], np.flatnonzero(bad), "right")] = True
    return out


#: Stops that cut a stretch when a letter or digit of ASCII, or a letter from U+00C0 to U+00FF, stands before them.
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:!?|", np.uint8))
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])


def _stops(x: np.ndarray) -> np.ndarray:
    out = _STOP[x]
    before = _ALNUM[x[:-1]]
    before[1:] |= (x[:-2] == 0xC3) & (x[1:-1] >= 0x80) & (x[1:-1] != 0x97) & (x[1:-1] != 0xB7)
    out[1:] &= before
    out[:1] = False
    return out


class ByteBpe:
    """Ids of whole texts by a byte-level BPE tokenizer of the tokenizers library.

    Such a tokenizer never joins a word to the blank or line feed behind it, nor a letter to the stop behind it, so in plain texts
    the stretches from one of these to the next are encoded once each and kept; other texts are encoded as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer: Tokenizer = Tokenizer.from_file(path)
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cache = WordCache(STRETCHES)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words without line feeds, encoded as the lines of texts of LINES lines."""
        texts = ["\n".join(words[k : k + LINES]) + "\n" for k in range(0, len(words), LINES)]
        parts = [np.array(e, np.uint32) for k in range(0, len(texts), LINES) for e in self.whole(texts[k : k + LINES])]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        ends = np.flatnonzero(ids == self.feed[0])
        counts = np.diff(ends, prepend=-1) - 1
        return ids[ids != self.feed[0]], counts

    def encode(self, s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the slice's documents, count for each)."""
        data, raw = s.data, s.data.tobytes()
        odd = _odd(s)
        # a stretch begins at each blank, behind and at each line feed, and at each document
        begin = np.zeros(len(data) + 1, bool)
        begin[:-1] = (data == 32) | (data == 10)
        begin[1:] |= begin[:-1] & np.concatenate([data == 10, [False]])[: len(data)]
        begin[:-1] |= _stops(data)
        begin[s.offsets] = True
        cuts = np.flatnonzero(begin[: len(data)])
        plain = ~odd[np.searchsorted(s.offsets[1:], cuts, "right")]
        start, end = cuts[plain], np.append(cuts[1:], len(data))[plain] if len(cuts) else cuts[plain]
        doc = np.searchsorted(s.offsets[1:], start, "right")
        feeds = data[start] == 10 if len(start) else np.zeros(0, bool)
        a, b = start[~feeds], end[~feeds]
        ids, counts = self.cache.lookup(
            T.span_hashes(data, a, b, 1), T.span_hashes(data, a, b, 2),
            lambda where: self._words([raw[x:y].decode("utf-8", "replace") for x, y in zip(a[where].tolist(), b[where].tolist(), strict=True)]),
        )
        sizes = np.ones(len(start), np.int64)
        sizes[~feeds] = counts
        flat = np.full(int(sizes.sum()), self.feed[0], np.uint32)
        flat[np.repeat(~feeds, sizes)] = ids
        n = np.bincount(doc, weights=sizes, minlength=s.n).astype(np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            extra = self.whole([raw[s.offsets[d] : s.offsets[d + 1]].decode("utf-8", "replace") for d in which])
            pieces = np.split(flat, np.cumsum(n)[:-1])
            for d, e in zip(which.tolist(), extra, strict=True):
                pieces[d] = np.array(e, np.uint32)
                n[d] = len(e)
            flat = np.concatenate(pieces)
        return flat, n


_OPEN: dict[str, ByteBpe] = {}


def _tokenizer(path: str) -> ByteBpe:
    if path not in _OPEN:
        _OPEN[path] = ByteBpe(path)
    return _OPEN[path]


def write_tokens(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of all documents, each ended by ``end_id``, to files in ascending order of doc_id; returns the table of files.

    The table has the columns of FILES (see the module too); files follow each other by part, then file. Null and empty texts have the
    end id only. Null doc_ids come first; rows that share one stand together, in the order of a hash of their texts, and may be
    dealt to several parts. Other columns of ``docs`` are not looked at. ``tokenizer`` is a path that the executors can read, of a
    byte-level BPE. No rows, no files.
    """
    n = partitions(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, k = _tokenizer(tokenizer), 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = part = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal k, size, before
            ids, sizes = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            docs_ = [x for h in held for x in h[2]]
            payload = write_file(ids, docs_, sizes)
            held.clear()
            row = ((part, pa.int32()), (k, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (len(docs_), pa.int64()), (payload, pa.binary()))
            k, size, before = k + 1, 0, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["part", "file", "before", "n_ids", "n_docs", "payload"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, names = batch.column("part")[0].as_py(), batch.column("doc_id").to_pylist()
            for s in T.slices(batch.column("text"), ENCODED):
                ids, counts = bpe.encode(s)
                ended = np.full(len(ids) + s.n, end_id, np.uint32)
                ends = np.cumsum(counts + 1) - 1
                inner = np.ones(len(ended), bool)
                inner[ends] = False
                ended[inner] = ids
                held.append((ended, counts + 1, names[s.first : s.first + s.n]))
                size += len(s.data)
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return staged(ordered.mapInArrow(run, FILES), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """From the table of files: doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document.

    The driver sums the ids of each part, one row a part, and hands the sums on as a table of as many rows; a file's own start in its
    part is in its row.
    """
    spark: SparkSession = files.sparkSession
    totals = sorted((r["part"], r["n"]) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    below, bases = 0, []
    for part, n in totals:
        bases.append((part, below))
        below += n
    starts = spark.createDataFrame(bases, "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                ids, docs, sizes = read_file(payload.as_py())
                ends = np.cumsum(sizes)
                raw, cut = memoryview(ids.astype("<u4").tobytes()), (4 * np.concatenate([[0], ends])).tolist()
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(starts) if len(bases) <= MAX_PARTS else starts, "part").select((F.col("base") + F.col("before")).alias("start"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
