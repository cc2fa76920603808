"""Repeated passages of words: a count-min sketch finds windows that may repeat, and only those are grouped exactly."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geolattice.llm import chunks as C
from geolattice.llm import text as T

#: Rows of the sketch, counters of a row for each window expected, and counters in one block of a row.
SKETCH_ROWS, COUNTERS_PER_WINDOW, BLOCK = 2, 4, 1 << 22
#: Bytes of text for each window, to size the sketch; being wrong costs precision of the first pass only.
BYTES_PER_WINDOW = 6
#: Windows found repeated that one bucket of the second pass expects.
GROUP_WINDOWS = 1 << 18
#: Bytes of text in a chunk: the larger, the fewer counters go out twice.
CHUNK_BYTES = 4 << 20
#: Kind of a message that comes back as it is.
NOTE = SKETCH_ROWS + 1
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


class _Chunk:
    """Windows of a chunk: two hashes of 64 bits (the second only if wanted), the document's rank by id, and word places."""

    def __init__(self, t: pa.Table, width: int, exact: bool = True):
        order = np.argsort(_ids(t), kind="stable")
        self.t = t.take(pa.array(order))
        self.ids = _ids(self.t)
        first, second, rank, self.parts = [], [], [], []
        for s in T.slices(self.t["text"]):
            w = T.words(s)
            at = T.whole_windows(w, width)
            words = T.span_hashes(s.data, w.start, w.end)
            first.append(T.window_hashes(words, width, 1)[at])
            if exact:
                second.append(T.window_hashes(T.mix(words), width, 2)[at])
                rank.append(w.doc[at] + s.first)
                self.parts.append((s, w, at))
        self.first, self.second, self.rank = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((first, np.uint64), (second, np.uint64), (rank, np.int64)))

    @property
    def key(self) -> int:
        return self.t["chunk"][0].as_py()


def _ids(t: pa.Table) -> np.ndarray:
    return t["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy()


def _cells(c: _Chunk, row: int, blocks: int) -> np.ndarray:
    """The counter of each window in a row of the sketch: its block, then its place in the block."""
    h = T.mix(c.first ^ np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1))
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)) * np.uint64(BLOCK) + (h & np.uint64(BLOCK - 1))


def _distinct(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counters in order, each once, and whether the chunk has it twice or more."""
    own = np.sort(cells)
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    at = np.flatnonzero(new)
    return own[at], np.diff(at, append=len(own)) > 1


def _sketch(c: _Chunk, blocks: int) -> Iterable[tuple[int, int, int, bytes]]:
    for row in range(SKETCH_ROWS):
        own, twice = _distinct(_cells(c, row, blocks))
        for block, part in C.split((own // np.uint64(BLOCK)).astype(np.int64)):
            within = (own[part] - np.uint64(block * BLOCK)).astype(np.uint32)
            yield block, c.key, row, C.pack(C.deltas(within), np.packbits(twice[part]))


def _merge_sketches(bodies: list[bytes]) -> list[bytes]:
    """Sums the chunks' counters (saturated at two) and tells each chunk which of its counters reach two."""
    cells, total = [], np.zeros(BLOCK, np.uint16)
    for body in bodies:
        delta, twice = C.unpack(body)
        at = np.cumsum(delta)
        total[at] = np.minimum(total[at] + 1 + np.unpackbits(twice, count=len(at)), 2)
        cells.append(at)
    return [C.pack(np.packbits(total[at] >= 2)) for at in cells]


def _estimated(c: _Chunk, answers: pa.Table, blocks: int) -> np.ndarray:
    """The windows that every row of the sketch counts twice or more."""
    at = np.arange(len(c.first))
    for row in range(SKETCH_ROWS):
        cell = _cells(c, row, blocks)
        own, _ = _distinct(cell)
        got = C.replies(answers, row)
        hot = np.zeros(len(own), bool)
        for block, part in C.split((own // np.uint64(BLOCK)).astype(np.int64)):
            hot[part] = np.unpackbits(C.unpack(got[block])[0], count=part.stop - part.start).view(bool)
        own, cell = own[hot], cell[at]
        at = at[own[np.minimum(np.searchsorted(own, cell), len(own) - 1)] == cell] if len(own) else at[:0]
    return at


def _sorted_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A stable order by both hashes; by the first alone where no two differ in the second only."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
    return order


class _Groups:
    """The chunk's windows estimated repeated, each text once: hashes in order and the document of the smallest id here."""

    def __init__(self, c: _Chunk, at: np.ndarray, buckets: int):
        self.at = at
        a, b, r = c.first[at], c.second[at], c.rank[at]
        order = _sorted_hashes(a, b)
        a, b, r = a[order], b[order], r[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.group = np.empty(len(a), np.int64)
        self.group[order] = np.cumsum(new) - 1
        # ranks grow with the place in the chunk, so the first of a group is the least
        self.first, self.second, self.least = a[new], b[new], r[new]
        self.bucket = ((self.first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _group_question(c: _Chunk, g: _Groups) -> Iterable[tuple[int, int, int, bytes]]:
    for bucket, part in C.split(g.bucket):
        docs, which = np.unique(g.least[part], return_inverse=True)
        yield bucket, c.key, SKETCH_ROWS, C.pack(C.deltas(g.first[part]), g.second[part], C.deltas(c.ids[docs]), which.astype(np.uint16 if len(docs) < 1 << 16 else np.uint32))
    # a note to itself, so that the last look need not ask the sketch again
    hot = np.zeros(len(c.first), bool)
    hot[g.at] = True
    yield c.key, c.key, NOTE, C.pack(np.packbits(hot))


def _merge_groups(bodies: list[bytes]) -> list[bytes]:
    """Tells for each window of each chunk whether some other chunk has it in a document with a smaller id."""
    first, second, doc, sizes = [], [], [], []
    if len(C.unpack(bodies[0])) == 1:  # notes
        return bodies
    for body in bodies:
        delta, b, ids, which = C.unpack(body)
        first.append(np.cumsum(delta, dtype=np.uint64))
        second.append(b)
        doc.append(np.cumsum(ids)[which])
        sizes.append(len(b))
    a, b, d = np.concatenate(first), np.concatenate(second), np.concatenate(doc)
    order = np.lexsort((d, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    least = d[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    earlier = np.empty(len(a), bool)
    earlier[order] = least < d[order]
    return [C.pack(np.packbits(x)) for x in np.split(earlier, np.cumsum(sizes)[:-1])]


def _removed(c: _Chunk, g: _Groups, answers: pa.Table) -> np.ndarray:
    got = C.replies(answers, SKETCH_ROWS)
    earlier = np.zeros(len(g.first), bool)
    for bucket, part in C.split(g.bucket):
        earlier[part] = np.unpackbits(C.unpack(got[bucket])[0], count=part.stop - part.start).view(bool)
    out = np.zeros(len(c.first), bool)
    out[g.at] = earlier[g.group] | (c.ids[c.rank[g.at]] > c.ids[g.least[g.group]])
    return out


def _result(c: _Chunk, removed: np.ndarray, width: int) -> pa.Table:
    n_words, n_removed, kept, done = [], [], [], 0
    for s, w, at in c.parts:
        gone = T.covered(len(w.start), at[removed[done : done + len(at)]], width)
        done += len(at)
        n_words.append(w.per_doc)
        n_removed.append(np.bincount(w.doc[gone], minlength=s.n))
        # the words that stay, each with a space before it unless it is its document's first
        start, end, doc = w.start[~gone], w.end[~gone], w.doc[~gone]
        size = end - start + 1
        place = np.cumsum(size) - size
        source = np.arange(int(size.sum())) - np.repeat(place - start, size) - 1
        out = s.data[np.maximum(source, 0)] if len(s.data) else np.zeros(0, np.uint8)
        out[place] = 32
        edges = np.concatenate([place, [len(out)]])[np.searchsorted(doc, np.arange(s.n + 1))]
        whole = out.tobytes()
        kept += [whole[a + 1 : b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    empty = np.zeros(0, np.int64)
    return pa.table({
        "doc_id": c.t["doc_id"], "n_words": pa.array(np.concatenate([*n_words, empty])), "n_removed": pa.array(np.concatenate([*n_removed, empty]).astype(np.int64)),
        "kept_sha256": pa.array(C.sha256_of(kept), pa.string()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def drop_repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 13, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 and kept_text.

    Words are runs of anything but ASCII white space, compared as they are. A word goes if a window of ``width`` words of its
    document covers it whose words also start somewhere in a document with a smaller id, as the documents came. kept_text has
    the other words, a space between. Null and empty texts have no words and keep an empty text; rows that share an id are one
    document for this rule; a null id is smaller than any other. Other columns of ``docs`` are not looked at.

    First look: every chunk counts its windows in a sketch of SKETCH_ROWS rows, and blocks of counters are summed over the chunks;
    each chunk hears which of its counters reach two. Those never underestimate, so no repeated window is lost. Second look: the
    windows whose counters all reach two go, with 128 bits of hash and the smallest id in the chunk, to be grouped exactly. Third
    look: the words are removed. The sketch grows with the corpus and no task or driver holds more than a block of it.
    """
    parts, total = C.chunked(docs, doc_id, text, chunk_bytes)
    expected = max(total // BYTES_PER_WINDOW, 1)
    blocks = max(1, expected * COUNTERS_PER_WINDOW // BLOCK)
    buckets = max(1, expected // GROUP_WINDOWS)
    counted = C.answer(C.ask(parts, lambda t: _sketch(_Chunk(t, width, exact=False), blocks)), _merge_sketches)

    def regroup(t: pa.Table, a: pa.Table) -> Iterable[tuple[int, int, int, bytes]]:
        c = _Chunk(t, width)
        return _group_question(c, _Groups(c, _estimated(c, a, blocks), buckets))

    grouped = C.answer(C.ask(parts, regroup, counted), _merge_groups)

    def finish(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({n: pa.array([], k) for n, k in (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()))})
        c = _Chunk(t, width)
        hot = np.unpackbits(C.unpack(C.replies(a, NOTE)[c.key])[0], count=len(c.first))
        return _result(c, _removed(c, _Groups(c, np.flatnonzero(hot), buckets), a), width)

    return parts.groupBy("chunk").cogroup(grouped.groupBy("chunk")).applyInArrow(finish, RESULT)
