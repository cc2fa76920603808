"""Repeated byte strings, found by merging sorted runs of suffixes that were exchanged front-coded.

Every string of ``length`` bytes is filed under the least (by hash) of its ``SEED``-byte substrings, so equal strings are filed
under equal substrings at equal offsets, and about one byte in 180 starts such an anchor. Only the suffixes that start at
anchors seen twice or more in the corpus are sorted: their order, the prefixes that neighbours share, and what stands before the
anchors decide about every string filed under them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geolattice.llm import chunks as C
from geolattice.llm import text as T

LENGTH, SEED = 400, 32
#: Anchors, and bytes of text, that a bucket of the first and second exchange expects.
SEEN_BUCKET, RUN_BUCKET_BYTES = 1 << 18, 4 << 20
#: An anchor that the corpus has more often is hot. Its suffixes are dealt by more than the anchor, see ``_Run``.
HOT = 2048
#: Bits of a hash that decide which substring is least; the rest hold its place, so the first of equals wins.
PLACE_BITS = np.uint64(24)
#: String starts of a slice that are looked at together.
STEP = 1 << 22
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
SEEN, RUN, NOTE = 0, 1, 2


class _Anchors:
    """Anchors of a slice: their places, hashes, and the first and last string starts filed under each."""

    def __init__(self, s: T.Slice, length: int):
        self.slice = s
        parts = [_least(s, a, min(a + STEP, len(s.data) - length + 1), length) for a in range(0, max(len(s.data) - length + 1, 0), STEP)]
        start, anchor = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ((), ())))
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        self.at, self.low = anchor[first], start[first]
        self.high = start[np.append(first[1:], len(anchor)) - 1] if len(first) else self.low
        # anchors have low hashes; mixed once more they spread evenly over the buckets
        self.hash = T.mix(T.span_hashes(s.data, self.at, self.at + SEED, 3))


def _least(s: T.Slice, begin: int, stop: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """String starts from ``begin`` to ``stop`` whose strings lie inside one document, and the anchor of each: by the upper bits of the hash, then by place."""
    data, width = s.data[begin : stop + length - 1], length - SEED + 1
    starts = np.arange(len(data) - SEED + 1)
    h = T.span_hashes(data, starts, starts + SEED, 3)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    key = (h & ~low) | starts.astype(np.uint64)
    # least of each run of ``width``: prefix and suffix minima of blocks of that width
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()[: len(key)]
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()[: len(key)]
    m = len(key) - width + 1
    anchor = (np.minimum(back[:m], fore[width - 1 :]) & low).astype(np.int64) + begin
    start = np.arange(begin, begin + m)
    inside = start + length <= s.offsets[1:][np.searchsorted(s.offsets[1:], start, "right")]
    return start[inside], anchor[inside]


def _slices(t: pa.Table, length: int) -> list[_Anchors]:
    return [_Anchors(s, length) for s in T.slices(t["text"])]


def _ordered(t: pa.Table) -> pa.Table:
    """A chunk's documents in an order that doesn't depend on how they came."""
    return t.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _seen_question(t: pa.Table, length: int, buckets: int, hot: int) -> Iterator[tuple[int, int, int, bytes]]:
    h, times = np.unique(np.concatenate([a.hash for a in _slices(_ordered(t), length)]), return_counts=True)
    for bucket, part in C.split(_bucket(h, buckets)):
        yield bucket, t["chunk"][0].as_py(), SEEN, C.pack(C.deltas(h[part]), np.minimum(times[part], hot + 1).astype(np.uint32))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _merge_seen(bodies: list[bytes], hot: int) -> list[bytes]:
    """Tells each chunk which of its anchors' substrings are anchors twice or more in the corpus, and which are hot."""
    hashes, times = [], []
    for body in bodies:
        delta, own = C.unpack(body)
        hashes.append(np.cumsum(delta, dtype=np.uint64))
        times.append(own)
    h, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(times), minlength=len(h))[inverse]
    return [C.pack(np.packbits(x >= 2), np.packbits(x > hot)) for x in np.split(total, np.cumsum([len(x) for x in hashes])[:-1])]


class _Run:
    """A chunk's suffixes at repeated anchors: for each bucket sorted, equal ones once, and where in the chunk they came from.

    An entry is the suffix from the anchor on, what stands before it, and how many bytes before the anchor the last of its strings
    starts. The suffixes of an anchor go to a bucket by its hash. A hot anchor's are dealt further: of its strings, those that start at
    most half a string before it share so many bytes behind its start, and the others so many before it, and these bytes choose the bucket.
    Equal strings have both alike, so they still meet, though strings that merely share the anchor do not.
    """

    def __init__(self, parts: list[_Anchors], wanted: list[tuple[np.ndarray, np.ndarray]], length: int, buckets: int):
        found: dict[int, dict[tuple[bytes, bytes, int], list[tuple[int, int]]]] = {}
        half = (length - SEED) // 2

        def add(k: int, raw: bytes, hashes: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
            for bucket, at, i, j in zip(_bucket(hashes, buckets).tolist(), p.tolist(), first.tolist(), last.tolist(), strict=True):
                found.setdefault(bucket, {}).setdefault((raw[at : j + length], raw[i:at], at - j), []).append((k, at))

        for k, (a, (want, hot)) in enumerate(zip(parts, wanted, strict=True)):
            raw, plain = a.slice.data.tobytes(), want & ~hot
            add(k, raw, a.hash[plain], a.at[plain], a.low[plain], a.high[plain])
            if hot.any():
                h, at, low, high = a.hash[hot], a.at[hot], a.low[hot], a.high[hot]
                near, far = at - high <= half, at - low > half
                behind = T.mix(h[near] ^ T.span_hashes(a.slice.data, at[near], at[near] + length - half, 5))
                add(k, raw, behind, at[near], np.maximum(low, at - half)[near], high[near])
                before = T.mix(h[far] ^ T.span_hashes(a.slice.data, at[far] - half - 1, at[far], 7))
                add(k, raw, before, at[far], low[far], np.minimum(high, at - half - 1)[far])
        self.buckets = {b: sorted(x.items()) for b, x in sorted(found.items())}

    def question(self, chunk: int) -> Iterator[tuple[int, int, int, bytes]]:
        for bucket, entries in self.buckets.items():
            yield bucket, chunk, RUN, _front_coded([e for e, _ in entries], [len(o) > 1 for _, o in entries])


def _shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that ``known`` bytes are common."""
    n = min(len(a), len(b))
    step, at = 32, known
    while at < n:
        if a[at : at + step] != b[at : at + step]:
            if step == 1:
                return at
            step = max(1, step >> 2) if step > 2 else 1
        else:
            at += min(step, n - at)
    return n


def _front_coded(entries: list[tuple[bytes, bytes, int]], twice: list[bool]) -> bytes:
    """A sorted run: of each suffix the length shared with the one before and the rest of it; the parts before anchors as they are."""
    shared, rests, before, last = [], [], [], b""
    for suffix, left, _ in entries:
        k = _shared_prefix(last, suffix)
        shared.append(k)
        rests.append(suffix[k:])
        before.append(left)
        last = suffix
    u = lambda x, kind=np.uint16: np.array(x, kind)
    texts = [np.frombuffer(b"".join(x), np.uint8) for x in (rests, before)]
    return C.pack(u(shared), u([len(x) for x in rests], np.uint32), u([len(x) for x in before]), u([x[2] for x in entries]), u(twice, np.uint8), *texts)


class Suffixes:
    """A sorted run as it came: front-coded. Only the suffix at hand is spelled out, and it moves on."""

    def __init__(self, shared: np.ndarray, n_rest: np.ndarray, rests: np.ndarray):
        self.n, self.place, self.at = len(shared), 0, 0
        self.shared, self.n_rest, self.rests = shared, n_rest, rests
        self.suffix = b""
        self._spell()

    def _spell(self) -> None:
        if self.place < self.n:
            stop = self.at + int(self.n_rest[self.place])
            self.suffix = self.suffix[: int(self.shared[self.place])] + self.rests[self.at : stop].tobytes()
            self.at = stop

    def move(self) -> None:
        self.place += 1
        self._spell()


def merge_runs(runs: list[Suffixes]) -> Iterator[tuple[int, int, int]]:
    """Merges sorted runs with a loser tree; yields (run, place, bytes shared with the suffix before) in order.

    Each run comes with the lengths that its suffixes share with the one before in the run. The tree keeps for every contender the
    length that it shares with the last suffix put out. Of two contenders the one that shares more is smaller, and no byte is
    looked at; if both share equally, comparing starts behind what is shared. The loser then knows its length to the winner.
    """
    n = 1
    while n < len(runs):
        n *= 2
    known = [0] * n
    ended = [k >= len(runs) or not runs[k].n for k in range(n)]
    loser = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known length becomes the one to the winner."""
        if ended[a]:
            return b, a
        if ended[b]:
            return a, b
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        s, t = runs[a].suffix, runs[b].suffix
        k = _shared_prefix(s, t, x)
        if k == len(s) or (k < len(t) and s[k] < t[k]):
            known[b] = k
            return a, b
        known[a] = k
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if n > 1 else 0
    while not ended[winner]:
        run = runs[winner]
        yield winner, run.place, known[winner]
        run.move()
        if run.place == run.n:
            ended[winner] = True
        else:
            known[winner] = int(run.shared[run.place])
        node = (winner + n) >> 1
        while node:
            winner, loser[node] = play(winner, loser[node])
            node >>= 1


def _backward(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings, given one behind the other, in order when read from the right: their places, and the bytes that each shares with the one before."""
    raw, stop = data[::-1].tobytes(), len(data) - np.cumsum(size)
    texts = [raw[a : a + n] for a, n in zip(stop.tolist(), size.tolist(), strict=True)]
    order = sorted(range(len(texts)), key=texts.__getitem__)
    shared, last = np.full(len(texts), -1, np.int64), b""
    for k, i in enumerate(order):
        if k:
            shared[k] = _shared_prefix(last, texts[i])
        last = texts[i]
    return np.array(order, np.int64), shared


def _merge_runs(bodies: list[bytes], length: int) -> list[bytes]:
    """Tells each chunk which strings filed under its suffixes occur elsewhere: for each suffix, ranges of the bytes before its anchor."""
    packed = [C.unpack(b) for b in bodies]
    base = np.cumsum([0] + [len(x[0]) for x in packed])
    n = int(base[-1])
    order, shared = np.empty(n, np.int64), np.empty(n, np.int64)
    for at, (k, i, s) in enumerate(merge_runs([Suffixes(x[0], x[1], x[5]) for x in packed])):
        order[at], shared[at] = base[k] + i, s
    flat = lambda k, kind: np.concatenate([np.zeros(0, kind), *[x[k] for x in packed]])
    left_len = flat(2, np.int64).astype(np.int64)
    lefts, backward = _backward(flat(6, np.uint8), left_len)
    left_len, back, twice = left_len[order], flat(3, np.int64).astype(np.int64)[order], flat(4, np.uint8)[order].astype(bool)
    del packed
    # what stands before the anchors, in order from the right: stretches that share j bytes there
    at = np.empty(n, np.int64)
    at[lefts] = np.arange(n)
    at = at[order]
    alone = lambda same: ~(same | np.append(same[1:], False))
    since, closed = np.full(n, -1, np.int32), []
    for j in range(int(left_len.max(initial=0)) + 1):
        same_right, same_left = shared >= length - j, backward >= j
        own = (back <= j) & (left_len >= j)
        hit = own & twice
        some = np.flatnonzero(own & ~alone(same_right) & ~alone(same_left)[at])
        if len(some) > 1:
            key = np.cumsum(~same_right)[some] * n + np.cumsum(~same_left)[at[some]]
            sort = np.argsort(key, kind="stable")
            same = key[sort][1:] == key[sort][:-1]
            hit[some[sort[1:][same]]] = True
            hit[some[sort[:-1][same]]] = True
        ended = np.flatnonzero(~hit & (since >= 0))
        if len(ended):
            closed.append((order[ended], since[ended].astype(np.int64), np.full(len(ended), j - 1)))
            since[ended] = -1
        since[hit & (since < 0)] = j
    rest = np.flatnonzero(since >= 0)
    closed.append((order[rest], since[rest].astype(np.int64), left_len[rest]))
    entry, from_, to = (np.concatenate(x) for x in zip(*closed, strict=True))
    sort = np.lexsort((from_, entry))
    entry, from_, to = entry[sort], from_[sort].astype(np.uint16), to[sort].astype(np.uint16)
    out = []
    for a, b in zip(base[:-1], base[1:], strict=True):
        x, y = np.searchsorted(entry, [a, b])
        out.append(C.pack((entry[x:y] - a).astype(np.uint32), from_[x:y], to[x:y]))
    T.trim()
    return out


def drop_repeated_strings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay).

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes covers it that also starts at another place of the corpus,
    the same document included and overlaps counted; all is judged on the documents as they came. n_spans counts the maximal
    removed runs. Null and empty texts have no bytes; texts shorter than ``length`` lose none; rows alike in every column are as many
    documents. Other columns of ``docs`` are not looked at. ``length`` is at least twice SEED.

    First look: chunks exchange the hashes of their anchors, and hear which the corpus has twice and which more than ``hot`` times. Second
    look: suffixes at those go out as sorted, front-coded runs, one a chunk and bucket, equal ones once; each bucket merges its runs
    and answers with the strings that repeat. Runs stay front-coded in the merge, and what stands before the anchors is compared
    byte by byte too. Third look: the bytes are removed. The text itself is exchanged once.
    """
    parts, total = C.chunked(docs, doc_id, text, chunk_bytes)
    seen_buckets = max(1, total // 180 // SEEN_BUCKET)
    run_buckets = max(8, total // RUN_BUCKET_BYTES)
    seen = C.answer(C.ask(parts, lambda t: _seen_question(t, length, seen_buckets, hot)), lambda bodies: _merge_seen(bodies, hot))

    def wanted(parts_: list[_Anchors], a: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """Which anchors of each slice are repeated, and which of them are hot."""
        h = np.unique(np.concatenate([x.hash for x in parts_]))
        got, again, often = C.replies(a, SEEN), np.zeros(len(h), bool), np.zeros(len(h), bool)
        for bucket, part in C.split(_bucket(h, seen_buckets)):
            again[part], often[part] = (np.unpackbits(x, count=part.stop - part.start).view(bool) for x in C.unpack(got[bucket]))
        at = [np.searchsorted(h, x.hash) for x in parts_]
        return [(again[x], often[x]) for x in at]

    def runs(t: pa.Table, a: pa.Table) -> Iterable[tuple[int, int, int, bytes]]:
        chunk, t = t["chunk"][0].as_py(), _ordered(t)
        own = _slices(t, length)
        want = wanted(own, a)
        yield from _Run(own, want, length, run_buckets).question(chunk)
        yield chunk, chunk, NOTE, C.pack(*[np.packbits(np.concatenate([*[x[k] for x in want], np.zeros(0, bool)])) for k in (0, 1)])
        T.trim()

    def merge(bodies: list[bytes]) -> list[bytes]:
        return bodies if len(C.unpack(bodies[0])) == 2 else _merge_runs(bodies, length)

    merged = C.answer(C.ask(parts, runs, seen), merge)

    def finish(t: pa.Table, a: pa.Table) -> pa.Table:
        chunk, t = (t["chunk"][0].as_py() if t.num_rows else -1), _ordered(t)
        own = _slices(t, length)
        gone = [np.zeros(len(x.slice.data) + 1, np.int64) for x in own]
        if own:
            sizes = np.cumsum([len(x.at) for x in own])
            want = zip(*[np.split(np.unpackbits(x, count=int(sizes[-1])).view(bool), sizes[:-1]) for x in C.unpack(C.replies(a, NOTE)[chunk])], strict=True)
            got = C.replies(a, RUN)
            for bucket, entries in _Run(own, list(want), length, run_buckets).buckets.items():
                which, from_, to = (x.tolist() for x in C.unpack(got[bucket]))
                for e, i, j in zip(which, from_, to, strict=True):
                    for k, p in entries[e][1]:
                        gone[k][p - j] += 1
                        gone[k][p - i + length] -= 1
        T.trim()
        return _result(t, own, [np.cumsum(g[:-1]) > 0 for g in gone])

    return parts.groupBy("chunk").cogroup(merged.groupBy("chunk")).applyInArrow(finish, RESULT)


def _result(t: pa.Table, own: list[_Anchors], gone: list[np.ndarray]) -> pa.Table:
    n_bytes, n_removed, n_spans, kept = [], [], [], []
    for a, g in zip(own, gone, strict=True):
        s = a.slice
        total = np.concatenate([[0], np.cumsum(g)])
        begin = g.copy()
        begin[1:] &= ~g[:-1]
        edge = s.offsets[1:-1]
        edge = edge[edge < len(g)]
        begin[edge] = g[edge]
        starts = np.concatenate([[0], np.cumsum(begin)])
        n_bytes.append(np.diff(s.offsets))
        n_removed.append(total[s.offsets[1:]] - total[s.offsets[:-1]])
        n_spans.append(starts[s.offsets[1:]] - starts[s.offsets[:-1]])
        left, cut = s.data[~g].tobytes(), s.offsets - total[s.offsets]
        kept += [left[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    flat = lambda x: pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64))
    return pa.table({"doc_id": t["doc_id"], "n_bytes": flat(n_bytes), "n_removed": flat(n_removed), "n_spans": flat(n_spans), "kept_sha256": pa.array(C.sha256_of(kept), pa.string()), "kept": pa.array(kept, pa.binary())})
