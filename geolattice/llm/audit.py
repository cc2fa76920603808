"""Filter interaction audit: what five filters remove in each of their 120 orders, and each filter's Shapley sum.

A document is its mask, one bit for each filter that it fails, so that all orders follow from the counts of 32 masks. The orders are
walked by swaps of neighbours: a swap changes what two steps remove and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolattice.llm.session import staged

FILTERS = "ABCDE"
#: A document with fewer words fails A; one of which fewer words in a hundred are different fails B; one with more capitals in a hundred characters fails C.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MASKS = 1 << len(FILTERS)
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)


def swaps(n: int) -> list[int]:
    """Places at which neighbours swap, one after the other, so that all orders of n things are visited once (plain changes)."""
    if n < 2:
        return []
    inner, out = swaps(n - 1), []
    for k in range(len(inner) + 1):
        # the last thing walks through the others, then back after their next swap
        out += range(n - 2, -1, -1) if k % 2 == 0 else range(n - 1)
        if k < len(inner):
            out.append(inner[k] + (k % 2 == 0))
    return out


def walk(total: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """(order, counts[part, step, column]) of each order; inputs are counts[part, mask]. Shapley sums are those of the whole walk."""
    n, masks = len(FILTERS), np.arange(MASKS)
    order, parts = list(range(n)), len(total)
    now = np.zeros((parts, n, len(_COUNTS)), np.int64)
    sums = np.zeros((parts, n), np.int64)
    fails = np.stack([total[:, masks >> f & 1 == 1].sum(axis=1) for f in range(n)], axis=1)

    def look(step: int) -> None:
        f, before = order[step], sum(1 << g for g in order[:step])
        here = (masks & before == 0) & (masks >> f & 1 == 1)
        removed = total[:, here].sum(axis=1)
        now[:, step] = np.stack([total[:, masks & (before | 1 << f) == 0].sum(axis=1), removed, fails[:, f] - removed, total[:, 1 << f], good[:, here].sum(axis=1), toxic[:, here].sum(axis=1), removed * 0], axis=1)

    for step in range(n):
        look(step)
    seen = []
    for at in [None, *swaps(n)]:
        if at is not None:
            order[at], order[at + 1] = order[at + 1], order[at]
            look(at)
            look(at + 1)
        sums[:, order] += now[:, :, 1]
        seen.append((list(order), now.copy()))
    for own, counts in seen:
        counts[:, :, 6] = sums[:, own]
        yield "".join(FILTERS[f] for f in own), counts


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 64):
            some = batch.slice(first, 64)
            cells = [some.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, MASKS) for c in ("total", "good", "toxic")]
            steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), some.num_rows))
            part = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), len(FILTERS))))
            for order, counts in walk(*cells):
                flat = counts.reshape(-1, len(_COUNTS))
                yield pa.RecordBatch.from_arrays([part, pa.array([order] * len(part)), steps, *[pa.array(flat[:, k]) for k in range(len(_COUNTS))]], names=["part", "filter_order", "step", *_COUNTS])


def _own_mask(text: Column) -> Column:
    """Bits of A to D, which a text alone decides; ``text`` isn't null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failed = [n < LEAST_WORDS, distinct * 100 < n * LEAST_DISTINCT, capitals * 100 > F.length(text).cast("long") * MOST_CAPITALS, text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc_id, part, mask) of each row of ``docs``: bit k is set if it fails the filter ``FILTERS[k]``.

    Null texts are empty, a null part is the empty string. E fails where a smaller id has the same text; a null id is neither
    smaller nor has it smaller ones, and rows alike in id and text don't fail for each other. An empty table gives no rows.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    known = staged(own.select("doc_id", "part", _own_mask(F.col("text")).alias("mask"), F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("hash")), "masks")
    # a text that a third of all rows have is one row here, and the join on id and hash spreads its rows
    first = known.filter("doc_id is not null").groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.lit(True).alias("__first"))
    both = known.join(first, ["hash", "doc_id"], "left")
    repeated = F.col("doc_id").isNotNull() & F.col("__first").isNull()
    return both.select("doc_id", "part", (F.col("mask") + F.when(repeated, MASKS >> 1).otherwise(0)).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order and step.

    ``masks`` says what fails. A document is good (toxic) if any label row of its id has quality (toxic) 1; ids without labels, null
    ids among them, are neither. Each row of ``docs`` counts, rows alike too. Parts come from ``docs``; no rows give no parts. Only
    the counts of masks, 32 for each part, are gathered, and parts are walked in tasks.
    """
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(one(quality).alias("good"), one(toxic).alias("toxic"))
    rows = masks(docs, doc_id=doc_id, text=text, part=part).join(known, "doc_id", "left")
    is_ = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    cells = rows.groupBy("part", "mask").agg(F.count("*").alias("n"), is_("good").alias("good"), is_("toxic").alias("toxic"))
    spread = lambda c: F.array(*[F.sum(F.when(F.col("mask") == k, F.col(c)).otherwise(0)) for k in range(MASKS)])
    return cells.groupBy("part").agg(spread("n").alias("total"), spread("good").alias("good"), spread("toxic").alias("toxic")).mapInArrow(_orders, SCHEMA)
