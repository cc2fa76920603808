"""SentencePiece BPE encoding with seeded merge-dropout, and decoding, over a public vocabulary.

Words are segmented by an agenda of candidate merges, best score first and the leftmost of equals. A keyed hash skips a candidate
with probability ``dropout``, so a seed gives one segmentation and another seed another, and any of them decodes to the text.
Candidates are skipped for each occurrence by itself. What an agenda comes to without skipping is drawn first: if an occurrence skips
nothing of it, that is its segmentation. Else what it skips is barred, and the agenda that bars this is asked for next, and so on. So a
segmentation follows from the word and the candidates barred, which are its key in the cache, and an agenda runs only for pairs not
met yet: side by side, one merge each at a time; a long word has an agenda of its own.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm import text as T
from geolattice.llm.session import bounded_batches
from geolattice.llm.wordcache import WordCache

#: Fixed value: the character that stands for a space in pieces.
MARK = "▁"
#: Bytes of text encoded at a time; a longer document is one slice.
SLICE_BYTES = 1 << 18
#: Characters beyond which a word has an agenda of its own, and bytes beyond which each of its occurrences has.
LONG = 400
_NONE = np.iinfo(np.int64).max
_PLACE = 20
#: Slots for pairs, as a power of two.
SLOT_BITS = 20
#: Bits of a piece in a merge; those above hold the character at which it starts, which is at most LONG.
PIECE_BITS = 23
#: Words whose agendas and segmentations a worker keeps.
KEPT = 500_000


class Pieces:
    """The vocabulary: pieces, their order as merges, and the bytes that ids decode to."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size = size
        assert size < 1 << PIECE_BITS, "a merge is kept in 32 bits"
        assert 3 * size.bit_length() < 63, "a pair and what it merges to are kept in 64 bits"
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {model.id_to_piece(i): i for i in normal}
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        assert not model.is_unknown(int(self.byte[0])), "the vocabulary must have byte pieces"
        # better scores come first; equal scores are equal, and the leftmost wins
        scores = np.array([model.get_score(i) for i in range(size)])
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.char = np.full(0x110000, -1, np.int64)
        for name, i in names.items():
            if len(name) == 1:
                self.char[ord(name)] = i
        self.char[ord(" ")] = self.char[ord(MARK)]
        self.char[ord(MARK)] = -1  # in a text it is no space, so it goes as bytes
        pairs = sorted({(names[a] * size + names[b], i) for name, i in names.items() for k in range(1, len(name)) if (a := name[:k]) in names and (b := name[k:]) in names})
        self.pair, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.merge_of = dict(pairs)
        # pairs by a hash with room to spare: in a slot its pair, whether it has more, and what the pair merges to; those more are in order
        self.bits = size.bit_length()
        slot, where = np.unique(self._slot(self.pair), return_index=True)
        self.slots = np.full(1 << SLOT_BITS, -1 << self.bits + 1)
        self.slots[slot] = (self.pair[where] << self.bits + 1) | self.merged[where]
        more = np.ones(len(self.pair), bool)
        more[where] = False
        self.slots[self._slot(self.pair[more])] |= 1 << self.bits
        self.more_pair, self.more_merged = self.pair[more], self.merged[more]
        self.chars = np.ones(size, np.int64)
        self.chars[list(names.values())] = list(map(len, names))
        spelled = [b""] * size
        for name, i in names.items():
            spelled[i] = name.replace(MARK, " ").encode()
        for b in range(256):
            spelled[self.byte[b]] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        self.length = np.diff(self.begin)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to, or -1."""
        key = left.astype(np.int64) * self.size + right
        found = self.slots[self._slot(key)]
        same = found >> self.bits + 1 == key
        out = np.where(same, found & (1 << self.bits) - 1, -1)
        rest = np.flatnonzero((found & 1 << self.bits != 0) & ~same)
        if len(rest):
            at = np.minimum(np.searchsorted(self.more_pair, key[rest]), len(self.more_pair) - 1)
            out[rest] = np.where(self.more_pair[at] == key[rest], self.more_merged[at], -1)
        out[(left < 0) | (right < 0)] = -1
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def skipped(key: np.ndarray, place: np.ndarray, merged: np.ndarray, dropout: float) -> np.ndarray:
    """Which candidates the keyed hash skips: key is a word's, place the character at which the candidate starts."""
    if dropout <= 0:
        return np.zeros(len(key), bool)
    h = T.mix(key ^ T.mix((place.astype(np.uint64) << np.uint64(24)) + merged.astype(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def ragged(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ..., of each run of ``counts`` places."""
    return np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def segment_one(pieces: Pieces, symbols: list[int], key: int, dropout: float) -> list[int]:
    """The agenda of one word, as a heap: symbols are character ids (-1: none in the vocabulary); gives the index of the first character and the id of each piece, in turn."""
    n = len(symbols)
    ids, after, before, alive = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int, int]] = []
    key_ = np.array([key], np.uint64)

    def propose(i: int) -> None:
        j = after[i]
        if j < n and ids[i] >= 0 and ids[j] >= 0:
            m = pieces.merge_of.get(ids[i] * pieces.size + ids[j])
            if m is not None and not skipped(key_, np.array([i]), np.array([m]), dropout)[0]:
                heapq.heappush(heap, (int(pieces.rank[m]), i, m, ids[i], ids[j]))

    for i in range(n - 1):
        propose(i)
    while heap:
        _, i, m, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = m, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            propose(before[i])
        propose(i)
    return [x for i in range(n) if alive[i] for x in (i, ids[i])]


def segment(pieces: Pieces, symbols: np.ndarray, counts: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Agendas of many words side by side: (word, first character, id) of each piece, in order. counts are the words' characters."""
    first = np.cumsum(counts) - counts
    word = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(symbols)) - np.repeat(first, counts)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    long_ = counts > LONG
    for w in np.flatnonzero(long_).tolist():
        flat = np.array(segment_one(pieces, symbols[first[w] : first[w] + counts[w]].tolist(), int(keys[w]), dropout), np.int64).reshape(-1, 2)
        done.append((np.full(len(flat), w), flat[:, 0], flat[:, 1]))
    if long_.any():
        short = ~long_[word]
        word, place, symbols = word[short], place[short], symbols[short]

    word, place, ids, _ = agendas(pieces, symbols, word, place, lambda w, at, m: skipped(keys[w], at, m, dropout))
    done.append((word, place, ids))
    word, place, ids = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((place, word))
    return word[order], place[order], ids[order]


Skip = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def agendas(pieces: Pieces, symbols: np.ndarray, word: np.ndarray, place: np.ndarray, skip: Skip | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """One merge of each word at a time: (word, first character, id) of each piece in no order, and the merges made, in turn, as words and
    packed numbers. ``skip`` tells of words, places and merged pieces which are not to be taken."""

    def candidates(i: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Agenda keys of the pairs that start at symbols i; last tells where a word ends."""
        out, i_ = np.full(len(i), _NONE), np.flatnonzero(~last[i])
        at = i[i_]
        m = pieces.merges(ids[at], ids[at + 1])
        ok = np.flatnonzero(m >= 0)
        own = was[at[ok]]
        if skip:
            free = ~skip(words[own], places[own], m[ok])
            ok, own = ok[free], own[free]
        out[i_[ok]] = (pieces.rank[m[ok]] << _PLACE) | places[own]
        return out

    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    made: list[tuple[np.ndarray, np.ndarray]] = []
    # a symbol knows its word and place by where it was
    was, words, places = np.arange(len(symbols), dtype=np.int32), word, place
    ids = symbols.astype(np.int32)
    last = np.ones(len(ids), bool)
    last[:-1] = word[1:] != word[:-1]
    agenda = candidates(np.arange(len(ids)), last)
    while len(ids):
        begin = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        best = np.repeat(np.minimum.reduceat(agenda, begin), np.diff(np.append(begin, len(ids))))
        stay = best != _NONE
        if not stay.all():
            done.append((words[was[~stay]], places[was[~stay]], ids[~stay].astype(np.int64)))
        hit = np.flatnonzero((agenda == best) & stay)
        stay[hit + 1] = False
        ids[hit] = pieces.merges(ids[hit], ids[hit + 1])
        made.append((words[was[hit]], (places[was[hit]] << PIECE_BITS) | ids[hit]))
        last[hit] = last[hit + 1]
        hit = (np.cumsum(stay) - 1)[hit]
        was, ids, last, agenda = was[stay], ids[stay], last[stay], agenda[stay]
        fresh = np.concatenate([hit, hit[(hit > 0) & ~last[np.maximum(hit - 1, 0)]] - 1])
        agenda[fresh] = candidates(fresh, last)
    done.append((np.zeros(0, np.int64),) * 3)
    return *(np.concatenate(x) for x in zip(*done, strict=True)), made


def merges_made(pieces: Pieces, symbols: np.ndarray, counts: np.ndarray, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed merges of each word's agenda in turn, how many a word has). barred has, in order, words above packed merges that are not to be taken."""

    def skip(w: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
        want = (w << 32) | (at << PIECE_BITS) | m
        return barred[np.minimum(np.searchsorted(barred, want), len(barred) - 1)] == want

    word = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
    *_, made = agendas(pieces, symbols, word, place, skip if len(barred) else None)
    made.append((np.zeros(0, np.int64),) * 2)
    word, merge = (np.concatenate(x) for x in zip(*made, strict=True))
    return merge[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(counts))


@dataclass
class Spelled:
    """Words as the code points of one behind the other, and how many each has."""

    points: np.ndarray
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)


@dataclass
class Drawn:
    """For each word the key of its own draws, and the merges that its agenda makes; a word with a count of -1 has an agenda to come."""

    keys: np.ndarray
    merges: np.ndarray
    counts: np.ndarray


class Codec:
    """Encodes and decodes slices of texts with one vocabulary, seed and dropout."""

    def __init__(self, path: str, seed: int, dropout: float):
        self.pieces, self.seed, self.dropout, self.cache, self.met = Pieces(path), np.uint64(seed), dropout, WordCache(KEPT), WordCache(KEPT)
        self.stride = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))

    def _drawn(self, word: np.ndarray, check: np.ndarray, own: np.ndarray, short: np.ndarray, spelled: Callable[[np.ndarray], Spelled]) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], Drawn]]:
        """Two hashes of each occurrence's word and barred candidates, and what has been drawn of occurrences; for the words' hashes, the
        occurrences' keys, and the occurrences that are ``short``."""
        key, second, at = np.where(short, word, own), np.where(short, check, T.mix(own)), np.flatnonzero(short)
        begin, n = np.zeros(len(word), np.int64), np.where(short, 0, -1)
        bars = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
        made, made_n = [np.zeros(0, np.int64)], 0
        barred_at, barred = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def agenda(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words, place = spelled(at[where]), np.full(len(word), -1)
            place[at[where]] = np.arange(len(where))
            mine = np.flatnonzero(place[barred_at] >= 0)
            return merges_made(self.pieces, self.pieces.char[words.points], words.counts, np.sort((place[barred_at[mine]] << 32) | barred[mine]))

        while len(at):
            merges, counts = self.met.lookup(key[at], second[at], agenda)
            merges = merges.astype(np.int64)
            begin[at], n[at] = made_n + np.cumsum(counts) - counts, counts
            made, made_n = [*made, merges], made_n + len(merges)
            whose = np.repeat(at, counts)
            hit = np.flatnonzero(skipped(own[whose], merges >> PIECE_BITS, merges & ((1 << PIECE_BITS) - 1), self.dropout))
            if not len(hit):
                break
            # what is barred is not made again, so this ends
            whose, merges = whose[hit], merges[hit]
            barred_at, barred = np.concatenate([barred_at, whose]), np.concatenate([barred, merges])
            first, token = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])), T.mix(merges.astype(np.uint64) + np.uint64(1))
            at = whose[first]
            for x, t in zip(bars, (token, T.mix(token ^ self.stride)), strict=True):
                x[at] += np.add.reduceat(t, first)
            key[at], second[at] = T.mix(word[at] ^ bars[0][at]), check[at] ^ bars[1][at]
        all_made = np.concatenate(made)
        return key, second, lambda where: Drawn(own[where], all_made[ragged(begin[where], np.maximum(n[where], 0))], n[where])

    def _words(self, words: Spelled, drawn: Drawn) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words in which a space is the mark; characters outside the vocabulary go as bytes."""
        points, counts = words.points, words.counts
        symbols, first = self.pieces.char[points], np.cumsum(counts) - counts
        word = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(points)) - np.repeat(first, counts)
        ids, n = symbols.copy(), np.maximum(drawn.counts, 0)
        # of the merges that start at a character the last stays, and what they cover behind it goes
        at, merged = np.repeat(first, n) + (drawn.merges >> PIECE_BITS), drawn.merges & ((1 << PIECE_BITS) - 1)
        ids[at] = merged
        inner = np.bincount(at + 1, minlength=len(ids) + 1) - np.bincount(at + self.pieces.chars[merged], minlength=len(ids) + 1)
        todo = drawn.counts < 0
        stay = (np.cumsum(inner[: len(ids)]) == 0) & ~todo[word]
        parts = [(word[stay], place[stay], ids[stay])]
        if todo.any():
            which = np.flatnonzero(todo)
            w, p, i = segment(self.pieces, symbols[todo[word]], counts[which], drawn.keys[which], self.dropout)
            parts.append((which[w], p, i))
        word, place, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(parts) > 1:
            order = np.lexsort((place, word))
            word, place, ids = word[order], place[order], ids[order]
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spelled = [chr(x).encode() for x in points[first[word[odd]] + place[odd]].tolist()]
            size = np.ones(len(ids), np.int64)
            size[odd] = [len(x) for x in spelled]
            out = np.repeat(ids, size)
            out[np.repeat(ids < 0, size)] = self.pieces.byte[np.frombuffer(b"".join(spelled), np.uint8)]
            word, ids = np.repeat(word, size), out
        return ids, np.bincount(word, minlength=len(counts))

    def encode(self, s: T.Slice, doc_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each document): a text that is not empty begins with a mark; doc_keys vary the segmentation."""
        some = s.offsets[:-1][np.diff(s.offsets) > 0]
        data = np.insert(s.data, some, 32)
        offsets = s.offsets + np.concatenate([[0], np.cumsum(np.diff(s.offsets) > 0)])
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(s.n, np.int64)
        # a word is a run of marks and what follows it; a line feed, which no piece joins, is one of its own
        space, feed = data == 32, data == 10
        begin = feed.copy()
        begin[0] = True
        begin[1:] |= space[1:] & ~space[:-1] | feed[:-1]
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        a = np.flatnonzero(begin)
        b = np.append(a[1:], len(data))
        doc = np.searchsorted(offsets[1:], a, "right")
        within = np.arange(len(a)) - np.searchsorted(doc, doc)
        h1, h2 = T.span_hashes(data, a, b, 1), T.span_hashes(data, a, b, 2)
        key = T.mix(h1 ^ T.mix(np.full(len(a), self.seed)))
        own, second, spelled = key, h2, _speller(data, a, b)
        drawn = lambda where: Drawn(own[where], np.zeros(0, np.int64), np.full(len(where), -1))
        if self.dropout > 0:
            own = T.mix(key ^ T.mix(doc_keys[doc] ^ T.mix(within.astype(np.uint64) + self.stride)))
            key, second, drawn = self._drawn(key, h2, own, b - a <= LONG, spelled)
        ids, counts = self.cache.lookup(key, second, lambda where: self._words(spelled(where), drawn(where)))
        return ids.astype(np.int64), np.bincount(doc, weights=counts, minlength=s.n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The documents' bytes, without the mark that encoding put first."""
        p = self.pieces
        size = p.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        source = np.repeat(p.begin[ids] - ends[:-1], size) + np.arange(int(ends[-1]))
        raw = p.spelled[source].tobytes()
        cut = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a + 1 : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _speller(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> Callable[[np.ndarray], Spelled]:
    """Spells out some of the words that go from a to b."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:

        def one_by_one(where: np.ndarray) -> Spelled:
            words = [raw[x:y].decode("utf-8", "replace") for x, y in zip(a[where].tolist(), b[where].tolist(), strict=True)]
            return Spelled(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.array([len(w) for w in words], np.int64))

        return one_by_one
    # characters begin at bytes that continue none
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first, counts = before[a], before[b] - before[a]
    return lambda where: Spelled(points[ragged(first[where], counts[where])], counts[where])


_OPEN: dict[tuple[str, int, float], Codec] = {}


def _codec(path: str, seed: int, dropout: float) -> Codec:
    if (path, seed, dropout) not in _OPEN:
        _OPEN[path, seed, dropout] = Codec(path, seed, dropout)
    return _OPEN[path, seed, dropout]


def _arrow(batch: pa.RecordBatch, parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *parts], names=[*batch.schema.names, *names])


def encode_pieces(docs: DataFrame, model: str, *, text: str = "text", key: str = "doc_id", seed: int = 1, dropout: float = 0.1, digest: bool = False, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` plus ids (array<int>) and n_tokens; with ``digest`` ids_crc32 and lossless instead of ids. Without
    ``keep_text`` the text itself is left out.

    ``model`` is the path of a SentencePiece BPE model with byte pieces, on every executor. Without dropout the ids are those of
    that library, but that a text's own U+2581 goes as bytes, so that decoding gives it back. With dropout each candidate merge of an
    occurrence of a word is skipped if a hash keyed by the seed, the word, ``key``, the word's ordinal in the text and the candidate's
    place says so. Null and empty texts have no ids. ids_crc32 is of the ids as little-endian
    unsigned 32-bit integers; lossless tells whether decoding gave the text's bytes. Columns that bear the new names are
    replaced. One pass, no exchange; a worker holds a batch, the vocabulary and a bounded cache of words.
    """
    bounded_batches(docs.sparkSession)
    names = ["n_tokens", "ids_crc32", "lossless"] if digest else ["n_tokens", "ids"]
    types = ["long", "long", "boolean"] if digest else ["long", "array<int>"]
    base = docs.drop(*[c for c in names if c in docs.columns and c not in (text, key)])
    keyed = base.withColumn("__key", F.xxhash64(key))
    left_out = ["__key"] if keep_text else ["__key", text]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema if f.name not in left_out] + [f"{n} {t}" for n, t in zip(names, types, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, seed, dropout)
        for batch in batches:
            own = batch.column("__key").to_numpy().view(np.uint64)
            rest = batch.drop_columns(left_out)
            for s in T.slices(batch.column(text), SLICE_BYTES):
                ids, counts = codec.encode(s, own[s.first : s.first + s.n])
                part = rest.slice(s.first, s.n)
                ends = np.concatenate([[0], np.cumsum(counts)])
                if digest:
                    raw, cut = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
                    crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    back, data, at = codec.decode(ids, counts), s.data.tobytes(), s.offsets.tolist()
                    same = [x == data[a:b] for x, a, b in zip(back, at[:-1], at[1:], strict=True)]
                    yield _arrow(part, [pa.array(counts), pa.array(crc, pa.int64()), pa.array(same)], names)
                else:
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    yield _arrow(part, [pa.array(counts), lists], names)

    return keyed.mapInArrow(run, schema)


def decode_pieces(tokens: DataFrame, model: str, *, ids: str = "ids", to: str = "text") -> DataFrame:
    """All columns of ``tokens`` but ``ids``, plus the decoded text in ``to``; null and empty ids give an empty text."""
    base = tokens.drop(*[c for c in (to,) if c in tokens.columns and c != ids])
    kept = [f for f in base.schema if f.name != ids]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [f"`{to}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, 0, 0.0)
        for batch in batches:
            lists = batch.column(ids)
            counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield _arrow(batch.drop_columns([ids]), [pa.array([x.decode("utf-8", "replace") for x in codec.decode(flat, counts)], pa.string())], [to])

    return base.mapInArrow(run, schema)
