"""MinHash near-dedup: many universal hash minima, bands, agreement of signatures, full sets, connected components.

Classes need no more links than join them, so a group of n alike documents is never compared pair by pair: its blocks are joined
through a few pivots first, and only what the pivots leave apart is compared across blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolattice.llm import text as T
from geolattice.llm.jaccard import _agreeing, _factors, _likely_members, _shingles, _tree, bands_and_rows, least_agreement
from geolattice.llm.session import bounded_batches, partitions, staged
from geolattice.operators.components import connected_components

#: Links have 100 * intersection >= PERCENT * union; a linked pair shares a band with at least RECALL.
PERCENT, RECALL = 85, 1 - 4e-7
#: Documents, and bytes of what they are judged by, that a task compares at once.
BLOCK_DOCS, BLOCK_BYTES = 1024, 8 << 20
#: Documents of a larger group, on average, that every one of its blocks holds.
PIVOTS = 16
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
_CELL = "array<struct<kind: int, lo: int, hi: int, side: int>>"
Judge = Callable[[list, np.ndarray, np.ndarray], np.ndarray]


def _lower(s: T.Slice) -> T.Slice:
    return T.Slice(s.first, T.LOWER[s.data], s.offsets)


def _sets(s: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Each document's different shingles in order of hash, and how many there are before each document (one more at the end)."""
    grams, doc = _shingles(_lower(s))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(s.n + 1))


def _keys(grams: np.ndarray, begin: np.ndarray) -> pa.Array:
    """128 bits of each set that isn't empty, whatever its order."""
    sums = np.stack([np.add.reduceat(T.mix(grams ^ np.uint64(c)), begin) if len(begin) else np.zeros(0, np.uint64) for c in (0x1234567, 0x9E3779B97F4A7C15)], axis=1)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.arange(len(begin) + 1) * 16).astype(np.int32)), pa.py_buffer(sums.tobytes())])


def _signed(hashes: int):
    factor, shift = _factors(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column("text")):
                grams, cut = _sets(s)
                size = np.diff(cut)
                some = np.flatnonzero(size)
                begin = cut[:-1][some]
                sig = np.empty((len(some), hashes), np.uint16)
                for k in range(hashes if len(some) else 0):
                    # a minimum is a small number, so its bits are mixed before 16 are kept
                    sig[:, k] = T.mix(np.minimum.reduceat(grams * factor[k] + shift[k], begin)).astype(np.uint16)
                place = np.full(s.n, -1)
                place[some] = np.arange(len(some))
                raw = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((np.arange(len(some) + 1) * 2 * hashes).astype(np.int32)), pa.py_buffer(sig.tobytes())])
                at = pa.array(place, mask=place < 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s.first, s.n), _keys(grams, begin).take(at), pa.array(size.astype(np.int64)), raw.take(at)], names=["doc_id", "key", "n_shingles", "sig"])

    return run


def _banded(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, bands * rows)
            band = np.zeros((len(sig), bands), np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for r in range(rows):
                band = T.mix(band ^ sig[:, r::rows].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(np.repeat(np.arange(len(sig)), bands))), pa.array(band.view(np.int64).ravel())], names=["node", "band"])

    return run


def _by_signature(hashes: int, least: int) -> Judge:
    def judge(payload: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sig = np.frombuffer(b"".join(payload), np.uint16).reshape(-1, hashes)
        return _agreeing(sig[a], sig[b], least)

    return judge


def _by_sets(percent: int) -> Judge:
    def judge(payload: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sets = [np.frombuffer(x, np.uint64) for x in payload]
        size = np.array([len(x) for x in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        some = count[column] > 1  # a shingle that one document alone has is in no intersection
        row, column = row[some], column[some]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        column = np.cumsum(np.diff(column, prepend=column[:1]) != 0) if len(column) else column
        place_a, place_b = np.full(len(sets), -1), np.full(len(sets), -1)
        place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
        common = np.zeros((len(a), len(b)), np.int64)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            x, y = np.searchsorted(column, [first, first + COLUMNS])
            r, c = row[x:y], column[x:y] - first
            width = int(c[-1]) + 1
            m, n = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
            m[place_a[r[place_a[r] >= 0]], c[place_a[r] >= 0]] = 1
            n[place_b[r[place_b[r] >= 0]], c[place_b[r] >= 0]] = 1
            common += np.rint(m @ n.T).astype(np.int64)  # whole numbers below 2**24
        return 100 * common >= percent * (size[a][:, None] + size[b][None] - common)

    return judge


def _stars(u: np.ndarray, v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as edges from one document of each, its least pivot if there is one."""
    ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    # pivots come first, so the least place of a component is its root
    order = np.lexsort((ids, ~np.isin(ids, pivots)))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(place[flat[: len(u)]].tolist(), place[flat[len(u) :]].tolist(), strict=True):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(len(ids))], np.int64)
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[order[root[other]]], ids[order[other]]


def _joining(judge: Judge, key: str):
    """Edges of a cell: as many as join what the judge links, between its two sides or, without a second side, among all."""

    def run(t: pa.Table) -> pa.Table:
        node, side = t["node"].to_numpy(), t["side"].to_numpy()
        pivots = node[t["pivot"].to_numpy()]
        _, first = np.unique(node * 2 + side, return_index=True)  # rows alike give one document
        node, side, payload = node[first], side[first], t["payload"].take(pa.array(first)).to_pylist()
        cross = side.any()
        a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(node)), np.arange(len(node)))
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(a) and len(b) and len(node) > 1:
            linked = judge(payload, a, b)
            u, v = _tree(node[a], node[b], linked if cross else np.triu(linked, 1))
            if not cross and len(u):
                u, v = _stars(u, v, pivots)
        T.trim()
        return pa.table({"group": t[key].slice(0, 1).take(pa.array(np.zeros(len(u), np.int64))), "src": pa.array(u, pa.int64()), "dst": pa.array(v, pa.int64())})

    return run


def _cell(kind: int, lo: Column, hi: Column, side: int) -> Column:
    return F.struct(F.lit(kind).alias("kind"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(side).alias("side"))


def _blocks_of(members: DataFrame, key: str) -> DataFrame:
    """Groups of more than one member with the blocks that they need."""
    sizes = members.groupBy(key).agg(F.count("*").alias("__n"), F.sum("bytes").alias("__w")).filter("__n > 1")
    return sizes.select(key, "__n", F.ceil(F.greatest(F.col("__n") / BLOCK_DOCS, F.col("__w") / BLOCK_BYTES)).cast("int").alias("__blocks"))


def _within(members: DataFrame, key: str) -> DataFrame:
    """(key, node, cells): each member's block; a pivot is in every block. About PIVOTS members are, told by hash, so no group is sorted."""
    rows = members.join(_blocks_of(members, key), key)
    own = F.pmod(F.xxhash64("node"), F.col("__blocks"))
    pivot = (F.col("__blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), F.col("__n")) < PIVOTS)
    every = F.transform(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda k: _cell(0, k, k, 0))
    return rows.select(key, "node", F.when(pivot, every).otherwise(F.array(_cell(0, own, own, 0))).cast(_CELL).alias("cells"))


def _across(members: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """(key, node, cells) that bring together all members of a group of several blocks which ``classes`` doesn't join yet.

    Classes are (key, node, component). Most of an alike group is one class by now: its members meet those outside it, and these meet each other.
    """
    rows = members.join(_blocks_of(members, key).filter("__blocks > 1").select(key), key, "left_semi")
    rows = rows.join(classes, [key, "node"], "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy(key, "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("w"))
    blocks = lambda n, w: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK_DOCS, w / BLOCK_BYTES))).cast("int")
    whole = parts.groupBy(key).agg(F.max(F.struct("n", "w", F.col("component").alias("most"))).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter("n > m.n")
    whole = whole.select(key, "m.most", blocks(F.col("m.n"), F.col("m.w")).alias("__a"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("__b"))
    rows = rows.join(whole, key)
    a, b = F.pmod(F.xxhash64("node"), F.col("__a")), F.pmod(F.xxhash64("node"), F.col("__b"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    inner = F.transform(upto("__b"), lambda k: F.when(k < b, _cell(2, k, b, 1)).otherwise(_cell(2, b, k, 0)))
    outer = F.transform(upto("__a"), lambda k: _cell(1, k, b, 1))
    cells = F.when(F.col("component") == F.col("most"), F.transform(upto("__b"), lambda k: _cell(1, a, k, 0))).otherwise(F.concat(inner, outer))
    return rows.select(key, "node", cells.cast(_CELL).alias("cells"))


def joining_edges(members: DataFrame, key: str, with_payload: Callable[[DataFrame], DataFrame], judge: Judge, name: str) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs that share a group of ``members`` (key, node, bytes) and that ``judge`` links.

    ``with_payload`` adds to rows of nodes what they are judged by. A group within BLOCK_DOCS and BLOCK_BYTES is one cell; larger ones
    are dealt to cells, first with pivots in each, then across what these leave apart. Blocks know their parts by the pivots that they
    share, so no components are computed in between. ``members`` should be a written table.
    """
    spark = members.sparkSession

    def judged(cells: DataFrame, k: int) -> DataFrame:
        rows = with_payload(cells).select(key, "node", "payload", (F.size("cells") > 1).alias("pivot"), F.explode("cells").alias("__cell")).select("*", "__cell.*").drop("__cell")
        rows = rows.repartition(partitions(spark), key, "kind", "lo", "hi")
        return staged(rows.groupBy(key, "kind", "lo", "hi").applyInArrow(_joining(judge, key), "group long, src long, dst long"), f"{name}-{k}")

    edges = judged(_within(members, key), 0)
    if _blocks_of(members, key).filter("__blocks > 1").isEmpty():
        return edges
    # each star's root is its part's name; a pivot that is in several stars takes the least
    classes = edges.groupBy(F.col("group").alias(key), F.col("dst").alias("node")).agg(F.min("src").alias("component"))
    return edges.unionByName(judged(_across(members, key, classes), 1))


def _with_sets(own: DataFrame, nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Adds the shingles of each node from its text, which few documents but those of the rows are exchanged for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column("text")):
                grams, cut = _sets(s)
                some = np.flatnonzero(np.diff(cut))
                part = batch.slice(s.first, s.n).take(pa.array(some))
                sets = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(np.append(cut[:-1][some], len(grams)).astype(np.int32) * 8), pa.py_buffer(grams.tobytes())])
                # an id with several texts brings them all
                same = pc.equal(part.column("key"), _keys(grams, cut[:-1][some]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("family", "node", "cells")], sets], names=["family", "node", "cells", "payload"]).filter(same)

    def add(rows: DataFrame) -> DataFrame:
        wanted = staged(rows.join(nodes.select("node", "doc_id", "key"), "node").withColumn("hash", F.col("doc_id")), "wanted")
        texts = _likely_members(own.withColumn("hash", F.col("doc_id")), wanted).select("doc_id", "text")
        both = texts.join(wanted.hint("merge"), "doc_id").select("family", "node", "key", "cells", "text")
        return both.mapInArrow(run, f"family long, node long, cells {_CELL}, payload binary")

    return add


def minhash_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, recall: float = RECALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    A to Z are lower-cased; words are runs of anything but ASCII white space; a document's set has its different shingles of five words,
    or with fewer words the whole sequence as one. Documents whose sets reach ``percent`` of intersection to union are linked, and
    component_id is the smallest id that links reach, kept whether it is the document's own. Null and empty texts, and those without
    words, have an empty set, no links and their own id. Rows with a null id link nothing: component_id is null and kept true. Rows
    alike, and texts of equal sets, share a component; an id with several texts takes part with each. No rows give no rows; other columns
    of ``docs`` aren't looked at. A pair at the threshold shares a band with probability ``recall`` at least, and each link is confirmed on
    whole sets.
    """
    bounded_batches(docs.sparkSession)
    bands, rows = bands_and_rows(percent / 100, recall)
    hashes = bands * rows
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = staged(own.mapInArrow(_signed(hashes), "doc_id long, key binary, n_shingles long, sig binary"), "sets")
    first = known.filter("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"))
    nodes = staged(first.withColumn("node", F.monotonically_increasing_id()), "nodes")  # a number for each different set, fixed by being written
    signed = staged(known.join(nodes.select("key", "doc_id", "node"), ["key", "doc_id"]).dropDuplicates(["node"]).select("node", "sig"), "signatures")
    pairs = staged(signed.mapInArrow(_banded(bands, rows), "node long, band long"), "bands")
    print_ = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"__x{k}") for k in (1, 2)]
    # near copies meet in many bands; bands with the same members count once
    once = pairs.groupBy("band").agg(F.count("*").alias("__c"), *print_).filter("__c > 1").groupBy("__c", "__x1", "__x2").agg(F.min("band").alias("band"))
    met = staged(pairs.join(once.select("band"), "band", "left_semi").withColumn("bytes", F.lit(2 * hashes)), "meetings")
    payload = signed.withColumnRenamed("sig", "payload")
    alike = joining_edges(met, "band", lambda r: r.join(payload, "node"), _by_signature(hashes, least_agreement(hashes, percent / 100)), "alike")
    families = connected_components(alike, staged).join(nodes.select("node", "n"), "node").select("node", F.col("component").alias("family"), (F.col("n") * 8).alias("bytes"))
    links = joining_edges(staged(families, "families"), "family", _with_sets(own, nodes), _by_sets(percent), "links")
    classes = connected_components(links, staged)
    named = classes.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
    found = nodes.join(classes.join(named, "component").select("node", "least"), "node", "left").select("key", F.coalesce("least", "doc_id").alias("least"))
    out = known.select("doc_id", "key", "n_shingles").join(found, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
