"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm import text as T
from geolattice.llm.session import bounded_batches, partitions, staged
from geolattice.operators.components import connected_components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: A pair this unlike may share a band with at most this probability.
UNLIKE, UNLIKE_SHARE = 0.3, 0.2
#: Documents of one family that a task holds at once; a larger family goes to tasks by pairs of blocks.
BLOCK_DOCS = 1024
#: Bytes of n-gram sets likewise.
BLOCK_BYTES = 8 << 20
#: Ids in families up to which their bitmap (16 bits each, 8 MB at most) is broadcast.
BITMAP_IDS = 4_000_000
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
_SIGNED = np.int64


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """The (bands, rows) with the fewest hashes that miss a pair at the threshold with probability 1 - recall at most, and let few unlike pairs through."""
    best: tuple[int, int, int] | None = None
    for rows in range(1, 13):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if 1 - (1 - UNLIKE**rows) ** bands <= UNLIKE_SHARE and (best is None or bands * rows < best[0]):
            best = (bands * rows, bands, rows)
    assert best
    return best[1], best[2]


def least_agreement(hashes: int, threshold: float = THRESHOLD, miss: float = 1e-9) -> int:
    """The number of equal hashes of which a pair at the threshold has fewer with probability ``miss`` at most."""
    below = 0.0
    for k in range(hashes + 1):
        below += comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > miss:
            return k
    return hashes


def _shingles(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each n-gram; the whole text is one for documents with fewer words than SHINGLE, but some."""
    w = T.words(s)
    h = T.span_hashes(s.data, w.start, w.end)
    at = T.whole_windows(w, SHINGLE)
    grams, doc = T.window_hashes(h, SHINGLE)[at], w.doc[at]
    n = w.per_doc
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        own = np.array([int(T.window_hashes(h[w.begin[d] : w.begin[d + 1]], int(n[d]))[0]) for d in few], np.uint64)
        doc, grams = np.concatenate([doc, few]), np.concatenate([grams, own])
        order = np.argsort(doc, kind="stable")
        doc, grams = doc[order], grams[order]
    return grams, doc


def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (rng.integers(0, 1 << 62, hashes, dtype=_SIGNED).astype(np.uint64) * np.uint64(2) + np.uint64(1)), rng.integers(0, 1 << 62, hashes, dtype=_SIGNED).astype(np.uint64)


def _signatures(bands: int, rows: int):
    factor, shift = _factors(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column("text")):
                grams, doc = _shingles(s)
                counts = np.bincount(doc, minlength=s.n)
                some = np.flatnonzero(counts)
                begin = (np.cumsum(counts) - counts)[some]
                sig = np.empty((len(some), len(factor)), np.uint32)
                for k in range(len(factor)):
                    sig[:, k] = (np.minimum.reduceat(grams * factor[k] + shift[k], begin) >> np.uint64(32)).astype(np.uint32) if len(some) else 0
                key = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                band = np.zeros((len(some), bands), np.uint64) + key
                for r in range(rows):
                    band = T.mix(band ^ sig[:, r::rows][:, :bands].astype(np.uint64))
                width = 4 * len(factor)
                flat = pa.Array.from_buffers(pa.list_(pa.int64()), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * bands).astype(np.int32))], children=[pa.array(band.view(np.int64).ravel())])
                raw = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * width).astype(np.int32)), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(some + s.first)) for c in ("doc_id", "hash")], flat, raw], names=["doc_id", "hash", "bands", "sig"])

    return run


def _agreeing(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of two blocks of signatures have ``least`` equal hashes."""
    total = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.uint16)
    for k in range(a.shape[1]):
        total += a[:, k, None] == b[None, :, k]
    return total >= least


def _tree(left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the documents of two blocks as the linked pairs do, fewer than there are documents."""
    ids, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    i, j = np.nonzero(linked)
    a, b = flat[i], flat[len(left) + j]
    # each document's first partner joins most; the rest seldom adds
    edges: list[tuple[int, int]] = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(x), find(y)
        if u != v:
            parent[max(u, v)] = min(u, v)
            edges.append((x, y))
    e = np.array(edges, np.int64).reshape(-1, 2)
    return ids[e[:, 0]], ids[e[:, 1]]


def _blocks(members: DataFrame, key: str, rank: str, weight: str | None = None) -> DataFrame:
    """Rows for each pair of blocks of a group that they take part in: one copy where a group is one block, else as many as blocks.

    The block of a row comes from a hash, with enough blocks for the group's count and for the bytes of ``weight``, so that no rank over a
    whole group is needed.
    """
    bytes_ = F.sum(F.octet_length(weight)) if weight else F.lit(0)
    sizes = members.groupBy(key).agg(F.count("*").alias("__n"), bytes_.alias("__w")).filter("__n > 1")
    sizes = sizes.select(key, F.ceil(F.greatest(F.col("__n") / BLOCK_DOCS, F.col("__w") / BLOCK_BYTES)).cast("int").alias("__blocks"))
    rows = members.join(sizes, key).withColumn("__own", F.pmod(F.xxhash64(rank), F.col("__blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda x: F.struct(F.least(x, F.col("__own")).alias("lo"), F.greatest(x, F.col("__own")).alias("hi")))
    return rows.withColumn("__pair", F.explode(pairs)).select("*", "__pair.lo", "__pair.hi").drop("__pair", "__blocks")


def _halves(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    own, lo, hi = t["__own"].to_numpy(), t["lo"][0].as_py(), t["hi"][0].as_py()
    return np.flatnonzero(own == lo), np.flatnonzero(own == hi), lo == hi


def _candidate_edges(hashes: int, least: int):
    def run(t: pa.Table) -> pa.Table:
        a, b, same = _halves(t)
        ids = t["node"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, hashes)
        linked = _agreeing(sig[a], sig[b], least)
        if same:
            linked &= a[:, None] < b[None, :]
        u, v = _tree(ids[a], ids[b], linked)
        T.trim()
        return pa.table({"src": pa.array(u, pa.int64()), "dst": pa.array(v, pa.int64())})

    return run


def _verify(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        a, b, same = _halves(t)
        ids = t["node"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), sizes)
        # n-grams that one document alone has add nothing to any intersection
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        new = np.concatenate([[True], column[1:] != column[:-1]]) if len(column) else np.zeros(0, bool)
        column = np.cumsum(new) - 1
        common = np.zeros((len(a), len(b)), np.float32)
        place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
        place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            x, y = np.searchsorted(column, [first, first + COLUMNS])
            m, n = np.zeros((len(a), COLUMNS), np.float32), np.zeros((len(b), COLUMNS), np.float32)
            r, c = row[x:y], column[x:y] - first
            ia, ib = place_a[r] >= 0, place_b[r] >= 0
            m[place_a[r[ia]], c[ia]] = 1
            n[place_b[r[ib]], c[ib]] = 1
            common += m @ n.T
        union = sizes[a][:, None] + sizes[b][None, :] - common
        linked = common >= threshold * union - 1e-3
        close = np.argwhere(linked & (common < threshold * union + 1e-3))
        for i, j in close.tolist():  # at the threshold itself, in whole numbers
            linked[i, j] = int(common[i, j]) * 1000 >= round(threshold * 1000) * int(union[i, j])
        if same:
            linked &= a[:, None] != b[None, :]
        links = np.zeros(len(sets), np.int64)
        np.add.at(links, a, linked.sum(axis=1))
        if not same:
            np.add.at(links, b, linked.sum(axis=0))
        u, v = _tree(ids[a], ids[b], linked & (a[:, None] < b[None, :]) if same else linked)
        n = len(ids)
        T.trim()
        return pa.table({
            "src": pa.array(np.concatenate([ids, u]), pa.int64()), "dst": pa.array(np.concatenate([ids, v]), pa.int64()), "links": pa.array(np.concatenate([links, np.zeros(len(u), np.int64)])),
        }).slice(0, n + len(u))

    return run


def _likely_members(docs: DataFrame, families: DataFrame) -> DataFrame:
    """The documents of families and a few others, so that few texts are exchanged: a bitmap of hashed ids, 16 bits for each, is broadcast.

    Its size is checked; beyond BITMAP_IDS all documents go on.
    """
    count = families.count()
    if count > BITMAP_IDS:
        return docs
    size = F.lit(max(64, 16 * count))
    bit = F.pmod(F.xxhash64("hash"), size)
    ones = families.select(bit.alias("b")).select((F.col("b") / 64).cast("long").alias("__block"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("m"))
    bitmap = ones.groupBy("__block").agg(F.bit_or("m").alias("__bits"))
    marked = docs.withColumn("__bit", bit).withColumn("__block", (F.col("__bit") / 64).cast("long")).join(F.broadcast(bitmap), "__block")
    return marked.filter("(shiftrightunsigned(__bits, cast(__bit % 64 as int)) & 1L) = 1").select(*docs.columns)


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in T.slices(batch.column("text")):
            grams, doc = _shingles(s)
            order = np.lexsort((grams, doc))
            grams, doc = grams[order], doc[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
            grams, doc = grams[new], doc[new]
            cut = np.searchsorted(doc, np.arange(s.n + 1)) * 8
            sets = pa.Array.from_buffers(pa.binary(), s.n, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(grams.tobytes())])
            part = batch.slice(s.first, s.n)
            yield pa.RecordBatch.from_arrays([part.column("family"), part.column("node"), sets], names=["family", "node", "grams"])


def _hash(text: str):
    """128 bits of the SHA-256 of a text with words; null for others."""
    return F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.substring(F.unhex(F.sha2(F.col(text), 256)), 1, 16))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, text_id, class_id, n_links, class_key) for each row of ``docs``.

    Words are runs of anything but ASCII white space; a text with fewer than SHINGLE words, but some, is one n-gram. Two texts are
    linked if the Jaccard similarity of their n-gram sets is ``threshold`` or more. A text is known by its hash, so rows that share an
    id but not the text take part each with its own. text_id is the least doc_id with the same text, class_id the least doc_id of all
    texts joined by links (copies included), n_links the number of different texts linked to this one. class_key is the hash of that class's first
    text, in order of id, then hash: where ids are unique it follows from class_id, and where an id has several texts it tells their
    classes apart. Texts without words, null ones among them, have no links and no class_key, and are alone in their class even if
    equal. Rows with a null id are left out of all classes: their columns are null, n_links 0; rows alike in id and text are rows alike. No rows give
    no rows. Other columns of ``docs`` are not looked at.

    Copies are set aside first. Texts meet where all hashes of a band agree; in a bucket, and then in a family of texts that
    buckets join, pairs are compared as matrices inside tasks, and only edges that span what is joined leave a task, so a group
    of near copies makes no rows for its pairs. Buckets and families beyond BLOCK_DOCS texts are dealt to tasks by pairs of blocks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    bands, rows = bands_and_rows(threshold, recall)
    least = least_agreement(bands * rows, threshold)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.withColumn("hash", F.when(F.col("doc_id").isNotNull(), _hash("text")))
    worded = own.filter("hash is not null")
    hashed = staged(own.select("doc_id", "hash"), "text-hashes")
    # each different text has a number, fixed by being written
    first = hashed.filter("hash is not null").groupBy("hash").agg(F.min("doc_id").alias("text_id"))
    texts = staged(first.withColumn("node", F.monotonically_increasing_id()), "texts")
    of_text = texts.withColumnRenamed("text_id", "doc_id")
    signed = worded.mapInArrow(_signatures(bands, rows), "doc_id long, hash binary, bands array<long>, sig binary")
    signed = staged(signed.join(of_text, ["hash", "doc_id"]).dropDuplicates(["hash", "doc_id"]).select("node", "bands", "sig"), "signatures")
    # numbers and band hashes alone tell which texts meet; the signatures then go to those
    pairs = signed.select("node", F.explode("bands").alias("band"))
    crowded = pairs.groupBy("band").agg(F.count("*").alias("__c")).filter("__c > 1").select("band")
    met = staged(pairs.join(crowded, "band", "left_semi"), "meetings").join(signed.select("node", "sig"), "node")
    blocks = _blocks(met, "band", "node").select("band", "node", "sig", "__own", "lo", "hi").repartition(n, "band", "lo", "hi")
    edges = blocks.groupBy("band", "lo", "hi").applyInArrow(_candidate_edges(bands * rows, least), "src long, dst long")
    families = connected_components(staged(edges.distinct(), "candidates"), staged)
    families = staged(families.select("node", F.col("component").alias("family")).join(of_text, "node"), "families")
    members = _likely_members(worded, families).join(families.hint("merge"), ["hash", "doc_id"]).dropDuplicates(["hash", "doc_id"])
    sets = members.select("family", "node", "text").mapInArrow(_gram_sets, "family long, node long, grams binary")
    checked = _blocks(sets, "family", "node", "grams").select("family", "node", "grams", "__own", "lo", "hi").repartition(n, "family", "lo", "hi").groupBy("family", "lo", "hi").applyInArrow(_verify(threshold), "src long, dst long, links long")
    checked = staged(checked, "links")
    links = checked.filter("src = dst").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    classes = connected_components(checked.filter("src <> dst").select("src", "dst"), staged)
    named = classes.join(texts, "node").groupBy("component").agg(F.min(F.struct("text_id", "hash")).alias("of"))
    found = links.join(classes.join(named, "component"), "node", "left").select("node", "links", "of")
    labelled = texts.join(found, "node", "left").select("hash", "text_id", F.coalesce("of.text_id", "text_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("of.hash", "hash").alias("class_key"))
    out = hashed.join(labelled, "hash", "left")
    return out.select(
        "doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.lower(F.hex("class_key")).alias("class_key"),
    )


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, in the columns of ``docs``: that with the least id, and of several such the one whose text's hash is least.

    Rows alike in id and text are one document, and one of them stays. Documents with a null id, and those without words (null and empty
    texts among them), are alone in their class and all stay. An empty table stays empty.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text).filter("doc_id = class_id and class_key is not null")
    firsts = found.select(F.col("doc_id").alias("__id"), F.unhex("class_key").alias("__hash")).distinct()
    keyed = docs.withColumns({"__id": F.col(doc_id).cast("long"), "__hash": F.when(F.col(doc_id).isNotNull(), _hash(text))})
    one = keyed.filter("__hash is not null").join(firsts, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"])
    return one.unionByName(keyed.filter("__hash is null")).select(*docs.columns)
