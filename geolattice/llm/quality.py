"""Line-first cleaning: lines are judged and removed before the document is.

Boilerplate is found in the corpus itself, in any language: a short line that stands between ever different lines. Copies don't make
one, since a copied line keeps its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm import text as T
from geolattice.llm.session import bounded_batches, staged

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Phrases, in lower case, that mark a line as boilerplate.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of service", "terms of use",
    "click here", "sign up", "log in to", "subscribe to our newsletter", "skip to content", "enable javascript",
)
#: A line fails if it has this many symbols for each word, three words or more, ...
SYMBOLS_PER_WORD = 0.5
#: ... or ends so large a share of at least five words in "!", ...
SHOUTED = 0.5
#: ... or has at least so many separators between items that hold two words or fewer on average (navigation), ...
SEPARATORS, WORDS_PER_ITEM = 3, 2.0
#: ... or so large a share of at least ten words equal to the word before.
STUTTER = 0.5
#: ... or is in a run of so many lines of so few words without a closing stop (a menu), ...
MENU_LINES, MENU_WORDS = 3, 4
#: ... or is boilerplate: at most so many words, with so many different lines before it and behind it (where it has any), none of which makes up more than a share.
LINE_WORDS, SURROUNDINGS, TOP_SHARE = 25, 20, 0.2
#: Up to so many boilerplate lines are broadcast (eight bytes each); a longer list stays a table and is joined.
BROADCAST_LINES = 500_000
#: What closes a sentence, as the last bytes of a line, whole characters.
STOPS = (b".", b"!", b"?", b":", b";", b"\"", b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xc2\xbb", b"\xe3\x80\x82", b"\xef\xbc\x81", b"\xef\xbc\x9f")
#: A document goes if the lines removed hold more than this share of its words, ...
MAX_LOST = 0.3
#: ... those that are boilerplate of the corpus aside, which may be harmless; with them, more than this.
MAX_LOST_WITH = 0.6

_PHRASES = regex.compile("|".join(BOILERPLATE).encode())
_SYMBOL, _SEPARATOR = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (SYMBOLS, b"|>"))
_HEAD = (np.arange(256) & 0xC0) != 0x80

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_bad_lines long, n_lost_words long, base_failed boolean, kept boolean"


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key stands elsewhere in the same document too, and of these the ones that are not the first."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:]], later[order[1:]] = same, same
    any_[order[:-1]] |= same
    return any_, later


class _Lines:
    """The lines of a slice: where they begin and stop (feed aside), their documents, words and hashes."""

    def __init__(self, s: T.Slice, w: T.Words):
        data = s.data
        cut = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([s.offsets[:-1], cut + 1, s.offsets[-1:]]))
        self.begin = begin[begin < len(data)] if len(data) else begin[:0]
        self.stop = np.concatenate([self.begin[1:], [len(data)]]) if len(self.begin) else self.begin
        self.body = np.where(data[self.stop - 1] == 10, self.stop - 1, self.stop) if len(self.begin) else self.stop
        self.doc = np.searchsorted(s.offsets[1:], self.begin, "right")
        self.of_word = np.searchsorted(self.begin, w.start, "right") - 1
        self.words = np.bincount(self.of_word, minlength=len(self.begin))
        self.hash = T.span_hashes(data, self.begin, self.body)
        # whether the last word ends in a stop; a character of several bytes counts whole
        last = np.zeros(len(self.begin), np.int64)
        last[self.of_word] = w.end
        self.closed = np.zeros(len(self.begin), bool)
        for stop in STOPS:
            self.closed |= np.logical_and.reduce([(last > k) & (data[np.maximum(last - 1 - k, 0)] == b) for k, b in enumerate(reversed(stop))])

    def menus(self) -> np.ndarray:
        """Lines in runs of MENU_LINES or more, blank ones between them aside, that are short and close with no stop."""
        some = np.flatnonzero(self.words > 0)
        short = (self.words[some] <= MENU_WORDS) & ~self.closed[some]
        edge = np.concatenate([[True], (self.doc[some][1:] != self.doc[some][:-1]) | (short[1:] != short[:-1])]) if len(some) else np.zeros(0, bool)
        run = np.cumsum(edge) - 1
        out = np.zeros(len(self.words), bool)
        if len(some):
            out[some] = short & (np.bincount(run) >= MENU_LINES)[run]
        return out


def _surroundings(text: str):
    """(line, side, other, n): how often the lines that may be boilerplate stand behind, or before, another line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column(text)):
                x = _Lines(s, T.words(s))
                some = np.flatnonzero(x.words > 0)
                near = np.flatnonzero(x.doc[some][1:] == x.doc[some][:-1])
                above, below = some[near], some[near + 1]
                line = np.concatenate([x.hash[below], x.hash[above]])
                other = np.concatenate([x.hash[above], x.hash[below]])
                side = np.repeat([0, 1], len(near))
                short = np.concatenate([x.words[below], x.words[above]]) <= LINE_WORDS
                line, other, side = line[short], other[short], side[short]
                _, first, n = np.unique(T.mix(line ^ T.mix(other + side.astype(np.uint64))), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line[first].view(np.int64)), pa.array(side[first].astype(np.int32)), pa.array(other[first].view(np.int64)), pa.array(n.astype(np.int64))], names=["line", "side", "other", "n"]
                )

    return run


def boilerplate(docs: DataFrame, text: str = "text") -> np.ndarray | DataFrame:
    """Hashes of the lines of ``docs`` that are boilerplate: in order where they are BROADCAST_LINES or fewer, else as a table (line).

    What a line must show is the same at every size of the corpus, so the list may grow with it.
    """
    pairs = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(_surroundings(text), "line long, side int, other long, n long")
    of = lambda k, f: f(F.when(F.col("side") == k, F.col("n")))
    sums = [x for k in (0, 1) for x in (of(k, F.count).alias(f"others{k}"), F.coalesce(of(k, F.sum), F.lit(0)).alias(f"all{k}"), of(k, F.max).alias(f"top{k}"))]
    lines = pairs.groupBy("line", "side", "other").agg(F.sum("n").alias("n")).groupBy("line").agg(*sums)
    # a side that few occurrences have, such as what follows a last line, says nothing
    varied = lambda k: (F.col(f"others{k}") >= SURROUNDINGS) & (F.col(f"top{k}") <= TOP_SHARE * F.col(f"all{k}"))
    rare = lambda k: 2 * F.col(f"all{k}") < F.col(f"all{1 - k}")
    found = staged(lines.filter((varied(0) | rare(0)) & (varied(1) | rare(1))).select("line"), "boilerplate")
    if found.count() > BROADCAST_LINES:
        return found
    return np.sort(found.toArrow()["line"].to_numpy().astype(np.int64).view(np.uint64))


def _short_lines(text: str):
    """(text_key, line): the lines of a text that may be boilerplate, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column(text)):
                x = _Lines(s, T.words(s))
                some = np.flatnonzero((x.words > 0) & (x.words <= LINE_WORDS))
                _, first = np.unique(T.mix(x.hash[some] ^ T.mix(x.doc[some].astype(np.uint64))), return_index=True)
                keys = batch.column("text_key").slice(s.first, s.n).take(pa.array(x.doc[some][first]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(x.hash[some][first].view(np.int64))], names=["text_key", "line"])

    return run


def _with_known(base: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """``base`` plus __lines, for each text the boilerplate lines it has; equal texts are looked up once."""
    key = F.sha2(F.col(text).cast("string").cast("binary"), 256)
    texts = base.select(key.alias("text_key"), F.col(text).cast("string").alias(text)).groupBy("text_key").agg(F.first(text).alias(text))
    lines = texts.mapInArrow(_short_lines(text), "text_key string, line long").join(known, "line", "left_semi")
    each = lines.groupBy(F.col("text_key").alias("__key")).agg(F.collect_list("line").alias("__lines"))
    return base.join(each, key == F.col("__key"), "left").drop("__key")


def _judge(s: T.Slice, max_lost: float, known: np.ndarray) -> tuple[dict[str, np.ndarray], list[bytes]]:
    data = s.data
    w = T.words(s)
    hashes = T.span_hashes(data, w.start, w.end)
    n_words = w.per_doc
    x = _Lines(s, w)
    begin, stop, line_doc, line_of, in_line = x.begin, x.stop, x.doc, x.of_word, x.words
    edges = np.concatenate([begin, [len(data)]])
    worded = in_line > 0
    _, later = _repeats(x.hash, np.where(worded, line_doc, -1 - np.arange(len(begin))))
    # 8-word windows that stand twice in a document
    at = T.whole_windows(w, 8)
    twice, _ = _repeats(T.window_hashes(hashes, 8)[at], w.doc[at])
    repeated = T.covered(len(hashes), at[twice], 8)
    # rules by line
    symbols, bars = _SYMBOL[data], _SEPARATOR[data]
    of_line = (lambda m: _sums(m, edges)) if len(begin) else (lambda m: np.zeros(0, np.int64))
    shouted = np.bincount(line_of[data[w.end - 1] == 33], minlength=len(begin)) if len(begin) else in_line
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    stutter = np.bincount(line_of[again], minlength=len(begin))
    separators = of_line(bars)
    # a lone separator is no item
    alone = np.bincount(line_of[(w.end - w.start == 1) & bars[w.start]], minlength=len(begin)) if len(begin) else in_line
    bad = (in_line >= 3) & (of_line(symbols) - separators >= SYMBOLS_PER_WORD * in_line)
    bad |= (in_line >= 5) & (shouted >= SHOUTED * in_line)
    bad |= (separators >= SEPARATORS) & (in_line - alone <= WORDS_PER_ITEM * (separators + 1))
    bad |= (in_line >= 10) & (stutter >= STUTTER * in_line)
    bad |= x.menus()
    if len(known):
        common = worded & (in_line <= LINE_WORDS) & (known[np.minimum(np.searchsorted(known, x.hash), len(known) - 1)] == x.hash)
    else:
        common = np.zeros(len(begin), bool)
    lower = T.LOWER[data].tobytes()
    for m in _PHRASES.finditer(lower):
        line = np.searchsorted(begin, m.start(), "right") - 1
        if m.end() <= stop[line] and in_line[line] <= LINE_WORDS:
            bad[line] = True
    bad &= worded
    words_of = lambda lines: np.bincount(line_doc[lines], weights=in_line[lines], minlength=s.n).astype(np.int64)
    by_rule, bad = words_of(bad), bad | common
    lost = words_of(bad)
    n_repeat = np.bincount(w.doc[repeated], minlength=s.n)
    failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    chars = (np.cumsum(inside[:-1]) > 0) & _HEAD[data]
    kept = ~failed & (by_rule <= max_lost * n_words) & (lost <= max(max_lost, MAX_LOST_WITH) * n_words)
    out = {
        "n_words": n_words, "word_chars": _sums(chars, s.offsets), "n_symbols": _sums(symbols, s.offsets), "n_dup_lines": np.bincount(line_doc[later], minlength=s.n),
        "n_repeat_words": n_repeat, "n_lines": np.bincount(line_doc, minlength=s.n), "n_bad_lines": np.bincount(line_doc[bad], minlength=s.n), "n_lost_words": lost, "base_failed": failed, "kept": kept,
    }
    hole = np.zeros(len(data) + 1, np.int64)
    np.add.at(hole, begin[bad], 1)
    np.add.at(hole, stop[bad], -1)
    stay = np.cumsum(hole[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(stay)])[s.offsets]
    left = data[stay].tobytes()
    return out, [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def clean_lines(docs: DataFrame, *, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """All columns of ``docs`` plus the statistics of STATS and cleaned_text, the text without the lines that failed.

    Words are runs of anything but ASCII white space; a null text has none. A document is kept unless it has fewer than 20
    words, more than 30 % of its words lie in 8-word windows that it has twice, or the removed lines held more than ``max_lost``
    of its words (with the corpus's boilerplate: MAX_LOST_WITH). Lines without words are never removed, so empty texts have no bad lines; they fail for want of words. Rows alike in
    every column are judged alike. Columns of ``docs`` that bear the new names are replaced.

    A first pass counts, over all documents, what stands before and behind short lines, and finds those that are boilerplate (see
    ``boilerplate``). Up to BROADCAST_LINES hashes are broadcast, and the second pass judges without an exchange; of a longer list
    each text gets its own lines by a join, with the same result. Memory is a few times a batch of bounded bytes, or the longest
    text. An empty table has no lines and stays empty.
    """
    bounded_batches(docs.sparkSession)
    found = boilerplate(docs, text)
    known = None if isinstance(found, DataFrame) else docs.sparkSession.sparkContext.broadcast(found)
    added = [x.split()[0] for x in STATS.split(", ")] + ["cleaned_text"]
    base = docs.drop(*[c for c in added if c in docs.columns and c != text])
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in base.schema]) + f", {STATS}, cleaned_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in T.slices(batch.column(text)):
                part = batch.slice(s.first, s.n)
                if known is None:
                    own = np.unique(part.column("__lines").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                    part = part.drop_columns(["__lines"])
                else:
                    own = known.value
                stats, cleaned = _judge(s, max_lost, own)
                arrays = [*part.columns, *[pa.array(v.astype(np.int64) if v.dtype != bool else v) for v in stats.values()], pa.array(cleaned, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *added])

    return (base if known is not None else _with_known(base, text, found)).mapInArrow(run, schema)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their cleaned text and its length, in the columns of ``docs``.

    Null and empty texts fail for want of words; rows alike in every column fare alike; an empty table stays empty.
    """
    done = clean_lines(docs).filter("kept")
    values = {"text": F.col("cleaned_text"), "n_chars": F.length("cleaned_text").cast("long")}
    return done.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])
