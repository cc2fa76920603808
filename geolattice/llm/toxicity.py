"""Toxicity by two Kneser-Ney models of words, one for each class, over back-off counts that both share.

A word follows the word before it, with absolute discounting: what a class discounts goes to its model of the word alone. That one makes a
word in two steps, its first PREFIX bytes and then the whole of it, each discounted likewise; what a class discounts there goes
to the shared distribution of the same step, whose counts come from the whole corpus. Counts are of different texts: of rows with equal
texts one counts. So an expression that a class has seen in DISCOUNT texts or less says nothing of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.llm import text as T
from geolattice.llm.session import bounded_batches, staged

PREFIX, DISCOUNT = 6, 3
#: Labelled documents from which the class models and the calibration are fitted, at most (expected value of a hash sample).
MAX_LABELLED = 40_000
#: Expressions of a task that are counted before they are handed on.
HELD = 1 << 20
#: Widths, in words, of the stretches whose length-normalised log-likelihoods are compared; 0 is the whole text.
WIDTHS = (1, 3, 12, 0)
#: Words whose ratio exceeds this are strong evidence; its sum for the root of the length is one more feature.
STRONG, FEATURES = 1.4, len(WIDTHS) + 1
#: Parents of steps are even, words as contexts of the next are odd.
ROOT = np.uint64(0x51A9D3F7C2B48E60)
EVEN, CONTEXT = ~np.uint64(1), np.uint64(0x9D2C5680CA4F1B37)
COUNTS = "cls int, parent long, child long, n long"
#: Repeated texts up to which a bitmap of their hashes (16 bits each, 8 MB at most) is broadcast.
BITMAP_TEXTS = 4_000_000
#: Rows of a table of parents up to which it is broadcast.
FEW = 200_000
#: Numbers of edges likewise, which are one long each; the labelled sample bounds them.
EDGES = 2_000_000
#: Bits of the cells in which expressions of the labelled texts are counted first, at least and at most, and the stripes that cells are dealt to.
CELL_BITS, STRIPES = (16, 26), 16
#: Stands for all children of a parent that no class has often enough for evidence.
REST = np.uint64(0x7C15D3A96E8B24F0)
#: Stands for the parts of a text that rows of several parts have: no model leaves all of these out.
SEVERAL = 5


def _expressions(s: T.Slice) -> tuple[T.Words, np.ndarray, np.ndarray]:
    """Words of a slice with the hashes of their prefixes and of the whole words."""
    w = T.words(s, T.ALNUM)
    return w, T.span_hashes(s.data, w.start, np.minimum(w.start + PREFIX, w.end), 5) & EVEN, T.span_hashes(s.data, w.start, w.end, 6)


def _contexts(w: T.Words, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that have one before them in their document, and what that one is as a context."""
    at = np.flatnonzero(w.doc[1:] == w.doc[:-1]) + 1
    return at, T.mix(whole[at - 1] ^ CONTEXT) | np.uint64(1)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def _first(values: list[np.ndarray]) -> np.ndarray:
    """Indexes of the first of each distinct combination of values."""
    order = np.lexsort(values[::-1])
    if not len(order):
        return order
    return order[np.concatenate([[True], np.any([v[order][1:] != v[order][:-1] for v in values], axis=0)])]


def _document_counts(s: T.Slice, pairs: bool) -> tuple[np.ndarray, ...]:
    """(document, parent, child) of each expression of each document, once; with ``pairs`` also of words behind the word before them."""
    w, prefix, whole = _expressions(s)
    own = _first([w.doc, whole])
    doc, pre, word = w.doc[own], prefix[own], whole[own]
    first = _first([doc, pre])
    parts = [(doc, pre, word), (doc[first], np.full(len(first), ROOT), pre[first])]
    if pairs:
        at, before = _contexts(w, whole)
        one = _first([w.doc[at], before, whole[at]])
        parts.append((w.doc[at][one], before[one], whole[at][one]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _summed(cls: np.ndarray, parent: np.ndarray, child: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(child):
        return cls, parent, child, n
    key = T.mix(child ^ T.mix(parent + cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    at = order[first]
    return cls[at], parent[at], child[at], np.add.reduceat(n[order], first)


def _count(batches: Iterator[pa.RecordBatch], pairs: bool = False, named: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Documents by class and expression, summed within a task; ``named`` gives what children are counted as."""
    held: list[tuple[np.ndarray, ...]] = []

    def out() -> pa.RecordBatch:
        c, p, k, n = _summed(*[np.concatenate(x) for x in zip(*held, strict=True)])
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), *[pa.array(x.view(np.int64)) for x in (p, k, n)]], names=["cls", "parent", "child", "n"])

    for batch in batches:
        cls = batch.column("cls").to_numpy(zero_copy_only=False)
        for s in T.slices(_lower(batch.column("text"))):
            doc, parent, child = _document_counts(s, pairs)
            child = named(parent, child) if named else child
            held.append(_summed(cls[s.first + doc], parent, child, np.ones(len(doc), np.int64)))
        if sum(len(h[0]) for h in held) > 2 * HELD:
            yield out()
    if held:
        yield out()


def _cell(parent: np.ndarray, child: np.ndarray, y: np.ndarray | int, bits: int) -> np.ndarray:
    """The cell of an expression of a class."""
    return (T.mix(T.mix(child ^ T.mix(parent)) + np.asarray(y, np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _often(labelled: DataFrame, discount: int, bits: int) -> np.ndarray:
    """Which cells (a bit each) have more than ``discount`` expressions of the labelled rows. Rows with equal texts count each: an expression
    of whose cells none is among these is in ``discount`` texts of a class or less."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(1 << bits, np.uint8), []

        def add() -> None:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            total[cell] = np.minimum(total[cell] + n, 255)
            held.clear()

        for batch in batches:
            cls = batch.column("cls").to_numpy(zero_copy_only=False)
            for s in T.slices(_lower(batch.column("text"))):
                doc, parent, child = _document_counts(s, True)
                held.append(_cell(parent, child, cls[s.first + doc], bits))
            if sum(map(len, held)) > 2 * HELD:
                add()
        if held:
            add()
        rows = [(k, pa.compress(x.tobytes(), "zstd", asbytes=True)) for k, x in enumerate(np.split(total, STRIPES))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["stripe", "cells"])

    def merge(t: pa.Table) -> pa.Table:
        size = (1 << bits) // STRIPES
        total = np.zeros(size, np.uint16)
        for body in t["cells"]:
            total = np.minimum(total + np.frombuffer(pa.decompress(body.as_py(), size, "zstd"), np.uint8), 255)
        return pa.table([pa.array([t["stripe"][0].as_py()], pa.int32()), pa.array([np.packbits(total > discount).tobytes()], pa.binary())], names=["stripe", "cells"])

    form = "stripe int, cells binary"
    found = labelled.select("cls", "text").mapInArrow(count, form).groupBy("stripe").applyInArrow(merge, form).collect()
    parts = {r["stripe"]: r["cells"] for r in found}
    return np.frombuffer(b"".join(bytes(parts.get(k, bytes((1 << bits) // STRIPES // 8))) for k in range(STRIPES)), np.uint8)


def _with_rest(often: np.ndarray, bits: int, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The children, REST for those that can't be evident."""
    few = np.ones(len(child), bool)
    for y in (0, 1):
        cell = _cell(parent, child, y, bits)
        few &= often[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1 == 0
    return np.where(few, REST, child)


class Model:
    """Log-likelihood ratios of expressions: those with evidence by key, all others by parent. Those of words behind a word are of the whole
    word, those of contexts are added to the word's own."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray, parents: np.ndarray, defaults: np.ndarray):
        """Keys and parents are in order; models share them."""
        self.keys, self.ratios, self.parents, self.defaults = keys, ratios.astype(np.float32), parents, defaults.astype(np.float32)

    @staticmethod
    def _at(sorted_: np.ndarray, values: np.ndarray, want: np.ndarray, default: np.ndarray | np.float32) -> np.ndarray:
        if not len(sorted_):
            return np.broadcast_to(default, want.shape).astype(np.float32)
        at = np.minimum(np.searchsorted(sorted_, want), len(sorted_) - 1)
        return np.where(sorted_[at] == want, values[at], default)

    def step(self, parent: np.ndarray, child: np.ndarray, own: np.ndarray | float = 0.0) -> np.ndarray:
        default = self._at(self.parents, self.defaults, parent, np.float32(0))
        return self._at(self.keys, self.ratios, T.mix(child ^ T.mix(parent)), default + own)

    def words(self, w: T.Words, prefix: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ratio of each word alone, and behind the one before it (which a document's first word doesn't have)."""
        _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
        pre = prefix[first]
        alone = (self.step(np.full(len(pre), ROOT), pre) + self.step(pre, whole[first]))[inverse].astype(np.float64)
        at, before = _contexts(w, whole)
        behind = alone.copy()
        behind[at] = self.step(before, whole[at], alone[at])
        return alone, behind

    def features(self, s: T.Slice) -> np.ndarray:
        """For each document the greatest length-normalised log-likelihood ratio of its stretches of each width; single words count alone."""
        w, prefix, whole = _expressions(s)
        alone, ratio = self.words(w, prefix, whole)
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        out = np.zeros((s.n, FEATURES))
        n = w.per_doc
        some = np.flatnonzero(n)
        out[:, -1] = np.bincount(w.doc, weights=np.maximum(alone - STRONG, 0), minlength=s.n) / np.sqrt(n + 1)
        for k, width in enumerate(WIDTHS):
            if not len(some):
                break
            if width == 0:
                out[some, k] = (total[w.begin[1:]] - total[w.begin[:-1]])[some] / n[some]
                continue
            if width == 1:
                out[some, k] = np.maximum.reduceat(alone, w.begin[:-1][some])
                continue
            # stretches end with their document, and are divided by their width even where that cuts them short
            stop = np.minimum(np.arange(len(ratio)) + width, w.begin[1:][w.doc])
            out[some, k] = np.maximum.reduceat((total[stop] - total[:-1]) / width, w.begin[:-1][some])
        return out


FOLDS = (0, 1, 2, 3, 4)


def _texts(docs: DataFrame) -> DataFrame:
    """Each different text of ``docs`` once. Only texts whose hash a broadcast bitmap of repeated hashes has are exchanged.

    Beyond BITMAP_TEXTS repeated texts, all are exchanged.
    """
    texts = docs.select("text").filter("text is not null")
    repeated = staged(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated-texts")
    count = repeated.count()
    if count > BITMAP_TEXTS:
        return texts.distinct()
    bits = max(64, 16 * count)
    bit = F.pmod("h", F.lit(bits))
    bitmap = repeated.withColumn("bit", bit).groupBy((F.col("bit") / 64).cast("long").alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    marked = texts.withColumn("h", F.xxhash64("text")).withColumn("bit", bit).withColumn("block", (F.col("bit") / 64).cast("long")).join(F.broadcast(bitmap), "block", "left")
    marked = marked.select("text", (F.expr("shiftrightunsigned(coalesce(bits, 0L), cast(bit % 64 as int)) & 1L") == 1).alias("again"))
    return marked.filter("not again").select("text").unionByName(marked.filter("again").select("text").distinct())


def _fit(labelled: DataFrame, docs: DataFrame, discount: int) -> list[Model]:
    """Models of the labelled rows (text, cls, part), with shared counts of all ``docs`` (text): that of all rows, then one without each part from 1 to 4."""
    part = F.when(F.min("part") == F.max("part"), F.min("part")).otherwise(SEVERAL)
    cells = labelled.groupBy("text", "cls").agg(part.alias("part")).select("text", (F.col("cls") + 2 * F.col("part")).cast("int").alias("cls"))
    n = {(y, k): F.sum(F.when((F.col("cls") % 2 == y) & (F.col("cls") != y + 2 * k), F.col("n")).otherwise(0)) for y in (0, 1) for k in FOLDS}
    # what can't be evident is told by a first count in cells, and is counted by its parent alone: discounting leaves all of it
    size = labelled.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size // 8).bit_length(), CELL_BITS[0]), CELL_BITS[1])
    often = labelled.sparkSession.sparkContext.broadcast(_often(labelled, discount, bits))
    rest = F.col("child") == int(REST.astype(np.int64))
    per_class = cells.mapInArrow(lambda batches: _count(batches, True, lambda parent, child: _with_rest(often.value, bits, parent, child)), COUNTS).groupBy("parent", "child").agg(*[x.alias(f"n{y}_{k}") for (y, k), x in n.items()])
    sums = [x for y, k in n for x in (F.sum(f"n{y}_{k}").alias(f"all{y}_{k}"), F.sum(F.when(rest, F.col(f"n{y}_{k}")).otherwise(F.least(f"n{y}_{k}", F.lit(discount)))).alias(f"left{y}_{k}"))]
    # of a parent's children only those with evidence are kept, which are few; the sums have the others
    child = F.when(~rest & (F.greatest("n0_0", "n1_0") > discount), F.struct("child", *[f"n{y}_{k}" for y, k in n]))
    per_class = staged(per_class.groupBy("parent").agg(*sums, F.collect_list(child).alias("evident")), "class-counts")
    parents = per_class.drop("evident")
    pair = F.col("parent").bitwiseAND(1) == 1
    evident = staged(per_class.select("parent", F.explode("evident").alias("e")).select("parent", "e.*"), "evident")
    known = staged(evident.select("parent").distinct(), "evident-parents")
    own = _few(staged(parents.join(_few(known), "parent", "left_semi"), "parents-of-evident"))
    # of the corpus, evident children are counted one by one and the others of their parents together, before anything is exchanged
    edge = F.xxhash64("parent", "child")
    named = staged(evident.filter(~pair).select(edge.alias("edge"), F.lit(True).alias("is_evident")).dropDuplicates(["edge"]), "evident-edges")
    corpus = _texts(docs).select("text", F.lit(0).alias("cls")).mapInArrow(_count, COUNTS).join(_few(known), "parent", "left_semi").withColumn("edge", edge)
    found = corpus.join(_few(named, EDGES), "edge", "left")
    shared = staged(found.groupBy("parent", F.when(F.col("is_evident"), F.col("child")).alias("child")).agg(F.sum("n").alias("n")), "shared-counts")
    totals = _few(staged(shared.groupBy("parent").agg(F.sum("n").alias("below")), "below-parents"))
    counts = [F.col(f"{x}{y}_{k}").cast("int").alias(f"{x}{y}_{k}") for x in ("n", "all", "left") for y, k in n]
    rows = evident.filter(~pair).join(shared, ["parent", "child"]).join(totals, "parent").join(own, "parent").select("parent", "child", (F.col("n") / F.col("below")).alias("base"), *counts).toArrow()
    behind = evident.filter(pair).join(own, "parent").select("parent", "child", *counts).toArrow()
    # what the classes leave for children without evidence, of parents that both know and that leave less than all
    left_of = lambda y, k: F.when(F.col(f"all{y}_{k}") > 0, F.log(F.col(f"left{y}_{k}") / F.col(f"all{y}_{k}"))).otherwise(0.0)
    both = parents.filter("all0_0 > 0 and all1_0 > 0 and (left0_0 < all0_0 or left1_0 < all1_0)").select("parent", *[(left_of(1, k) - left_of(0, k)).cast("float").alias(f"s{k}") for k in FOLDS]).toArrow()
    u = lambda t, x: t[x].to_numpy().astype(np.int64).view(np.uint64)
    base, parent, child = rows["base"].to_numpy(), u(rows, "parent"), u(rows, "child")
    # a word that is evident behind another is evident alone, and so is its prefix: their rows, for each pair
    by_child = np.argsort(child, kind="stable")
    find = lambda want: by_child[np.minimum(np.searchsorted(child[by_child], want), len(child) - 1)]
    word = find(u(behind, "child")) if len(child) else np.zeros(0, np.int64)
    prefix = find(parent[word]) if len(child) else word
    keys = np.concatenate([T.mix(child ^ T.mix(parent)), T.mix(u(behind, "child") ^ T.mix(u(behind, "parent")))])
    a, b = np.argsort(keys), np.argsort(u(both, "parent"))
    keys, known_parents, models = keys[a], u(both, "parent")[b], []
    for k in FOLDS:
        logs, pairs = [], []
        for y in (0, 1):
            own_, total, left = (rows[f"{x}{y}_{k}"].to_numpy().astype(float) for x in ("n", "all", "left"))
            p = np.where(total > 0, (np.maximum(own_ - discount, 0) + left * base) / np.maximum(total, 1), base)
            logs.append(np.log(p))
            own_, total, left = (behind[f"{x}{y}_{k}"].to_numpy().astype(float) for x in ("n", "all", "left"))
            alone = p[word] * p[prefix]
            pairs.append(np.log(np.where(total > 0, (np.maximum(own_ - discount, 0) + left * alone) / np.maximum(total, 1), alone)))
        models.append(Model(keys, np.concatenate([logs[1] - logs[0], pairs[1] - pairs[0]])[a], known_parents, both[f"s{k}"].to_numpy()[b]))
    return models


def _few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of parents or edges that labelled documents give evidence for, broadcast where it has ``most`` rows at most: the root and
    the common prefixes, which have many children, then need no exchange of these."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression with a small ridge, by Newton's method: (centre, scale, weights with the intercept last)."""
    if not len(y) or y.min() == y.max():
        k = x.shape[1] if x.ndim == 2 else FEATURES
        return np.zeros(k), np.ones(k), np.append(np.zeros(k), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    ridge = np.diag([0.3] * x.shape[1] + [1e-6])
    weights = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, weights


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", discount: int = DISCOUNT, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted, log_ratio) for each row of ``docs``.

    Words are runs of ASCII letters and digits and of all characters above U+007F, in lower case. Labels are read only for rows
    whose crc32(doc_id as text) mod 5 is not 0. The probabilities are calibrated on these rows too, each scored by models that leave
    out the rows with its remainder. A hash sample of ``max_labelled`` rows is used where there are more. The counts that both classes back off to are those of all documents, and each
    document is scored by its whole text. score is the calibrated probability; log_ratio the toxic less the ordinary
    log-likelihood for each word. Null and empty texts have log_ratio 0 and the score of a text without evidence. Null ids and
    labels train nothing (a null id is held_out false); repeated ids and labels calibrate as often as they come, and rows with
    equal texts are counted once, in each class that they have. Without
    labels of both classes the score is the prior.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("cls")).filter("doc_id is not null and cls in (0, 1)").filter(fold() != 0)
    share = min(1.0, max_labelled / max(known.count(), 1))
    if share < 1:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    labelled = staged(rows.join(known, "doc_id").withColumn("part", fold().cast("int")), "labelled")
    models = spark.sparkContext.broadcast(_fit(labelled, rows, discount))

    def features(column: pa.Array, model: Model) -> np.ndarray:
        return np.concatenate([np.zeros((0, FEATURES)), *[model.features(s) for s in T.slices(_lower(column))]])

    def with_features(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(x[:, k])) for k in range(FEATURES)]], names=[batch.schema.names[0], *[f"x{k}" for k in range(FEATURES)]])

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Labelled documents by the models that have not seen them."""
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            for k in FOLDS[1:]:
                if (part == k).any():
                    own = batch.filter(pa.array(part == k))
                    yield with_features(own, features(own.column("text"), models.value[k]))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_features(batch, features(batch.column("text"), models.value[0]))

    columns = ", ".join(f"x{k} double" for k in range(FEATURES))
    seen = labelled.select("cls", "part", "text").mapInArrow(unseen, f"cls int, {columns}").toArrow()
    x = np.column_stack([seen[f"x{k}"].to_numpy() for k in range(FEATURES)])
    centre, scale, weights = _calibrate(x, seen["cls"].to_numpy())
    z = sum((F.lit(float(w / s)) * (F.col(f"x{k}") - F.lit(float(c))) for k, (c, s, w) in enumerate(zip(centre, scale, weights[:-1], strict=True))), F.lit(float(weights[-1])))
    done = rows.mapInArrow(featured, f"doc_id long, {columns}").withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    held = F.coalesce(fold() == 0, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col(f"x{len(WIDTHS) - 1}").alias("log_ratio"))
