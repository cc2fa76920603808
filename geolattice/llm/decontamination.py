"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Items are dealt to blocks; a task builds the automaton of each block and lays it out as flat arrays, which are broadcast. Documents
pass once, as arrays of words: all stretches of a slice walk the automaton side by side, a word at a time.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from geolattice.llm import text as T
from geolattice.llm.session import bounded_batches, staged

#: Bytes of items in a block, and in the blocks that one pass over the documents takes.
BLOCK_BYTES, PASS_BYTES = 2 << 20, 8 << 20


def normal_words(s: T.Slice) -> tuple[T.Words, np.ndarray]:
    """Words of a slice, ASCII letters in lower case: runs of ASCII letters and digits and of all characters above 0x7F; and their hashes."""
    w = T.words(s, T.ALNUM)
    return w, T.span_hashes(T.LOWER[s.data], w.start, w.end, 12)


class _Builder:
    """Suffix automaton of several word sequences, as dictionaries, while it grows."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for ids in sequences:
            state = 0
            for x in ids:
                state = self._extend(state, x)

    def _state(self, length: int, like: int = -1) -> int:
        self.next.append(dict(self.next[like]) if like >= 0 else {})
        self.link.append(self.link[like] if like >= 0 else -1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, x: int) -> int:
        clone = self._state(self.length[p] + 1, q)
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, x: int) -> int:
        q = self.next[last].get(x)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, x)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, x)
        return new

    def path(self, ids: list[int]) -> list[int]:
        out, state = [], 0
        for x in ids:
            state = self.next[state][x]
            out.append(state)
        return out


def _csr(pairs: set[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each of n keys begin, and the values, from (key, value) pairs."""
    flat = np.array(sorted(pairs), np.int32).reshape(-1, 2)
    return np.searchsorted(flat[:, 0], np.arange(n + 1)).astype(np.int32), np.ascontiguousarray(flat[:, 1])


@dataclass
class Automaton:
    """The automaton of a block of items as flat arrays. Walking a document's words keeps the longest suffix that some item contains.

    ``vocabulary`` are word hashes in order, a word's id its place; ``edge`` are transitions as state * len(vocabulary) + word, in order,
    leading to ``to``. ``top`` is of each state the shortest one on its suffix links with ``window`` words or more (-1: none), ``short``
    the first on them, itself included, whose words are a whole short item of ``short_words`` words (-1: none). ``of_top`` and
    ``of_short`` list the items.
    """

    window: int
    names: list[str | None]
    vocabulary: np.ndarray
    bigrams: np.ndarray
    edge: np.ndarray
    to: np.ndarray
    link: np.ndarray
    length: np.ndarray
    top: np.ndarray
    short: np.ndarray
    short_words: np.ndarray
    of_top: tuple[np.ndarray, np.ndarray]
    of_short: tuple[np.ndarray, np.ndarray]
    shortest: int

    @classmethod
    def of(cls, items: pa.Table, window: int) -> Automaton:
        """Of a table (i, t) of item ids and texts."""
        items = items.sort_by([("i", "ascending"), ("t", "ascending")])
        hashes: list[np.ndarray] = []
        for s in T.slices(items["t"]):
            w, h = normal_words(s)
            hashes += np.split(h, w.begin[1:-1])
        vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        sequences = [np.searchsorted(vocabulary, h).tolist() for h in hashes]
        b = _Builder(sequences)
        n, v = len(b.link), max(len(vocabulary), 1)
        link, length = np.array(b.link, np.int32), np.array(b.length, np.int32)
        edges = np.array(sorted((s * v + x, q) for s, own in enumerate(b.next) for x, q in own.items()), np.int64).reshape(-1, 2)
        top, up = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        words_, tops, wholes = np.zeros(n, np.int32), set(), set()
        for k, ids in enumerate(sequences):
            if 0 < len(ids) < window:
                state = b.path(ids)[-1]
                # a state stands for one whole short item at most: those of its words that are none lead to states of their own
                wholes.add((state, k))
                words_[state] = len(ids)
        for s in np.argsort(length, kind="stable").tolist():  # links lead to shorter states
            p = b.link[s]
            top[s] = top[p] if p >= 0 and top[p] >= 0 else s if length[s] >= window else -1
            up[s] = s if words_[s] else up[p] if p >= 0 else -1
        for k, ids in enumerate(sequences):
            tops.update((int(top[s]), k) for s in b.path(ids) if top[s] >= 0)
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(x[:-1], np.int64) << 32 | np.array(x[1:], np.int64) for x in sequences]]))
        shortest = min([window, *[len(x) for x in sequences if 0 < len(x)]])
        return cls(window, items["i"].to_pylist(), vocabulary, pairs, np.ascontiguousarray(edges[:, 0]), edges[:, 1].astype(np.int32), link, length, top, up, words_, _csr(tops, n), _csr(wholes, n), shortest)

    def _step(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after one more word each, and whether there is a transition."""
        key = state * len(self.vocabulary) + x
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        found = self.edge[at] == key
        return np.where(found, self.to[at], 0), found

    def walk(self, ids: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, state, words matched) for each word of the stretches [begin, stop)."""
        order = np.argsort(begin - stop, kind="stable")
        begin, size = begin[order], (stop - begin)[order]
        state, matched = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t))  # those longer than t come first
            state, matched = state[:n], matched[:n]
            x = ids[begin[:n] + t]
            to, found = self._step(state, x)
            lost = np.flatnonzero(~found & (state > 0))
            while len(lost):
                state[lost] = self.link[state[lost]]
                matched[lost] = self.length[state[lost]]
                to[lost], found[lost] = self._step(state[lost], x[lost])
                lost = lost[~found[lost] & (state[lost] > 0)]
            state, matched = to.astype(np.int64), np.where(found, matched + 1, 0)
            out.append((begin[:n] + t, state.copy(), matched.copy()))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]

    def hits(self, w: T.Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spans of words that windows cover, as starts and ends, and the items with an occurring window, as documents and items.

        A walk starts afresh after every pair of adjacent words that no item has, since no match of two words or more spans it;
        stretches too short for a window aren't walked.
        """
        none = np.zeros(0, np.int64)
        if not len(self.vocabulary) or not len(hashes):
            return none, none, none, none
        ids = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[ids] == hashes
        joined = known[:-1] & known[1:] & (w.doc[:-1] == w.doc[1:])
        if len(self.bigrams):
            own = np.flatnonzero(joined)
            pair = ids[own] << 32 | ids[own + 1]
            joined[own] = self.bigrams[np.minimum(np.searchsorted(self.bigrams, pair), len(self.bigrams) - 1)] == pair
        else:
            joined[:] = False
        edges = np.flatnonzero(~np.concatenate([[False], joined, [False]]))
        begin, stop = edges[:-1], edges[1:]
        worth = (stop - begin >= self.shortest) & known[begin]
        at, state, matched = self.walk(ids, begin[worth], stop[worth])
        a, b, items, docs = [none], [none], [none], [none]

        def note(rows: np.ndarray, start: np.ndarray, keys: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> None:
            a.append(start)
            b.append(at[rows] + 1)
            pair = np.unique(np.stack([w.doc[at[rows]], keys], axis=1), axis=0)
            count = lists[0][pair[:, 1] + 1] - lists[0][pair[:, 1]]
            place = np.repeat(lists[0][pair[:, 1]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            items.append(lists[1][place].astype(np.int64))
            docs.append(np.repeat(pair[:, 0], count))

        rows = np.flatnonzero(matched >= self.window)
        if len(rows):
            note(rows, at[rows] - matched[rows] + 1, self.top[state[rows]].astype(np.int64), self.of_top)
        up = self.short[state]
        rows = np.flatnonzero(up >= 0)
        up = up[rows].astype(np.int64)
        while len(rows):
            n = self.short_words[up]
            own = np.flatnonzero(matched[rows] >= n)
            if len(own):
                note(rows[own], at[rows[own]] - n[own] + 1, up[own], self.of_short)
            parent = self.link[up]
            up = np.where(parent >= 0, self.short[parent], -1).astype(np.int64)
            rows, up = rows[up >= 0], up[up >= 0]
        return np.concatenate(a), np.concatenate(b), np.concatenate(docs), np.concatenate(items)


def _automata(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> DataFrame:
    """(block, payload): the items with text by a hash of the text, in as many blocks as their measured size needs."""
    rows = items.filter(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    n = -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes) or 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")).repartition(n, "block")

    def build(t: pa.Table) -> pa.Table:
        done = pickle.dumps(Automaton.of(t.select(["i", "t"]), window), protocol=5)
        T.trim(0)
        return pa.table({"block": t["block"][:1], "payload": pa.array([done], pa.binary())})

    return staged(dealt.groupBy("block").applyInArrow(build, "block int, payload binary"), "automata")


_RESULT = [
    S.StructField("n_words", S.LongType()), S.StructField("n_hit", S.LongType()), S.StructField("n_items", S.LongType()), S.StructField("item_ids", S.ArrayType(S.StringType())),
    S.StructField("items_sha256", S.StringType()), S.StructField("hit_spans", S.ArrayType(S.LongType())), S.StructField("contaminated", S.BooleanType()), S.StructField("clean_text", S.StringType()),
]
_BETWEEN = [S.StructField("__spans", S.ArrayType(S.LongType())), S.StructField("__ids", S.ArrayType(S.StringType()))]


def find_benchmark(
    docs: DataFrame, items: DataFrame, *, window: int = 10, max_hit_share: float = 0.0, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """All columns of ``docs`` plus n_words, n_hit, n_items, item_ids, items_sha256, hit_spans, contaminated and clean_text.

    Words are normalised as in ``normal_words`` and compared by 64-bit hashes. A window is ``window`` consecutive words of one item, or
    the whole of an item with fewer words (but some). hit_spans are the maximal runs of document words inside occurring windows, as
    [start, end). clean_text is the text with those words removed, and what stands between them; white space around a cut closes up to
    one space. It is null where n_hit / n_words exceeds ``max_hit_share`` when that is over 0 (coverage limit). Null and empty texts have
    no words and keep their value in clean_text. item_ids are strings in string order; items with equal ids count once; the
    windows of an item with a null id are hit like others, but no id is listed for it; items without words or with null text never occur. Rows alike
    in every column are judged alike. Columns of ``docs`` that bear the new names are replaced.

    Blocks of items up to ``pass_bytes`` together are broadcast to one pass over the documents, without exchange; items beyond that take
    further passes in the same stage, each over the result of the one before. A worker holds the flat automata of a pass, a batch of
    bounded bytes (or the longest text) and a few times a slice of it.
    """
    added = [f.name for f in _RESULT]
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.drop(*[c for c in added if c in docs.columns and c != text])
    table = _automata(items, item_id, item_text, window, block_bytes)
    blocks = sorted(r["block"] for r in table.select("block").collect())
    group = max(1, pass_bytes // block_bytes)
    groups = [blocks[k : k + group] for k in range(0, len(blocks), group)] or [[]]
    out = base
    for k, own in enumerate(groups):
        payloads = [r["payload"] for r in table.filter(F.col("block").isin(own)).orderBy("block").collect()] if own else []
        shared = spark.sparkContext.broadcast([bytes(p) for p in payloads])
        last = k == len(groups) - 1
        out = out.mapInArrow(_pass(shared, text, max_hit_share, k > 0, last), S.StructType([*base.schema.fields, *(_RESULT if last else _BETWEEN)]))
    return out


def _runs(w: T.Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered words inside documents: starts, ends and documents."""
    n = len(w.start)
    inside = np.cumsum((np.bincount(a, minlength=n + 1) - np.bincount(b, minlength=n + 1))[:n]) > 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | (w.doc[1:] != w.doc[:-1])
    end[:-1] &= ~inside[1:] | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, w.doc[first]


def _without(raw: bytes, start: np.ndarray, end: np.ndarray, spans: list[int]) -> str:
    """The text without the words of the spans; start and end are byte places of its words."""
    parts, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        parts.append(raw[at : start[a]].decode("utf-8", "surrogatepass").rstrip(" "))
        at = int(end[b - 1])
    parts.append(raw[at:].decode("utf-8", "surrogatepass"))
    return parts[0] + "".join((p if p[:1] in ("", " ", "\n") or not parts[0] else " " + p) for p in parts[1:])


def _pass(shared, text: str, max_hit_share: float, later: bool, last: bool):
    """A pass over the documents. Between passes spans and ids travel in columns; the last one judges the documents."""

    def judged(batch: pa.RecordBatch, s: T.Slice, w: T.Words, per_doc: list[list[int]], names: list[set[str]]) -> list[pa.Array]:
        n_words = w.per_doc
        hit = np.array([sum(x[1::2]) - sum(x[::2]) for x in per_doc], np.int64)
        listed = [sorted(x) for x in names]
        given = batch.column(text)
        clean = given
        some = np.flatnonzero(hit)
        if len(some):
            raw = s.data.tobytes()
            new: dict[int, str | None] = {}
            for d in some.tolist():
                x, y = int(s.offsets[d]), int(s.offsets[d + 1])
                own = slice(w.begin[d], w.begin[d + 1])
                over = max_hit_share and hit[d] > max_hit_share * n_words[d]
                new[d] = None if over else _without(raw[x:y], w.start[own] - x, w.end[own] - x, per_doc[d])
            mask = np.zeros(len(given), bool)
            mask[some] = True
            clean = pa.compute.replace_with_mask(given, pa.array(mask), pa.array([new[d] for d in some.tolist()], given.type))
        sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed]
        return [
            pa.array(n_words), pa.array(hit), pa.array([len(x) for x in listed], pa.int64()), pa.array(listed, pa.list_(pa.string())), pa.array(sha, pa.string()),
            pa.array(per_doc, pa.list_(pa.int64())), pa.array(hit > 0), clean.cast(pa.string()),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: list[Automaton] = [pickle.loads(p) for p in shared.value]
        for batch in batches:
            for s in T.slices(batch.column(text)):
                part = batch.slice(s.first, s.n)
                w, hashes = normal_words(s)
                found = [x.hits(w, hashes) for x in automata]
                names: list[set[str]] = [set() for _ in range(s.n)]
                for x, (_, _, docs, items) in zip(automata, found, strict=True):
                    for d, k in zip(docs.tolist(), items.tolist(), strict=True):
                        if x.names[k] is not None:
                            names[d].add(x.names[k])
                a, b = ([f[k] for f in found] + [np.zeros(0, np.int64)] for k in (0, 1))
                if later:
                    lists = part.column("__spans")
                    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    base = np.repeat(w.begin[:-1], lists.value_lengths().to_numpy(zero_copy_only=False))
                    a.append((flat + base)[::2])
                    b.append((flat + base)[1::2])
                    for own, old in zip(names, part.column("__ids").to_pylist(), strict=True):
                        own.update(old)
                    part = part.drop_columns(["__spans", "__ids"])
                first, stop, doc = _runs(w, np.concatenate(a), np.concatenate(b))
                per_doc: list[list[int]] = [[] for _ in range(s.n)]
                for d, x, y in zip(doc.tolist(), (first - w.begin[doc]).tolist(), (stop - w.begin[doc]).tolist(), strict=True):
                    per_doc[d] += (x, y)
                if last:
                    more, fields = judged(part, s, w, per_doc, names), _RESULT
                else:
                    more, fields = [pa.array(per_doc, pa.list_(pa.int64())), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], _BETWEEN
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *[f.name for f in fields]])

    return run


def decontaminated(docs: DataFrame, items: DataFrame, max_hit_share: float = 0.5) -> DataFrame:
    """The documents in their own columns, without benchmark spans; those with more than ``max_hit_share`` of their words in such spans go.

    Null and empty texts have no words and stay as they are; rows alike in every column fare alike; an empty table stays empty.
    """
    done = find_benchmark(docs, items, max_hit_share=max_hit_share).filter(F.col("clean_text").isNotNull() | ~F.col("contaminated"))
    values = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return done.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])
