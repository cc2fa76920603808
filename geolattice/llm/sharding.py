"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until splitters fit, then one exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolattice.llm.session import staged

#: Characters of a key, of these the ones that name a group of equal texts, and those that one round of probes adds.
KEY_CHARS, GROUP_CHARS, ROUND_CHARS = 32, 16, 2
#: Pieces of shards at most, so that probes, their counts and the table of pieces stay bounded however many rows there are.
MAX_PIECES = 4096


def _key(text: str, doc_id: str):
    """Sort key: 16 hex digits of the text's hash, then 16 of the id's. Equal texts stand together."""
    hexed = [F.lpad(F.hex(F.xxhash64(F.col(c))), 16, "0") for c in (text, doc_id)]
    return F.concat(*hexed)


def _counts(keyed: DataFrame, depth: int, open_: list[str]) -> dict[str, tuple[int, int]]:
    """Bytes and rows below each probe: the prefixes of depth + ROUND_CHARS characters inside the ``open_`` ones of ``depth``."""
    part = keyed
    if depth:
        probes = keyed.sparkSession.createDataFrame([(p,) for p in open_], "prefix string")
        part = keyed.join(F.broadcast(probes), F.substring("key", 1, depth) == F.col("prefix"), "left_semi")
    found = part.groupBy(F.substring("key", 1, depth + ROUND_CHARS).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    return {r["p"]: (r["b"], r["n"]) for r in found.collect()}


def _own_shard(keyed: DataFrame, first: dict[str, tuple[int, int]], n_shards: int) -> list[str]:
    """Groups of equal texts with more bytes than the shards that the others share would have: each has a shard of its own.

    Fewer than ``n_shards`` prefixes can hold so much, so a round has few probes; most tables need none beyond the first.
    """
    done, heavy = dict(first), {}
    while len(heavy) < n_shards - 1 and done:
        share = sum(b for b, _ in done.values()) / (n_shards - len(heavy))
        large = sorted((p for p, (b, _) in done.items() if b > share), key=lambda p: (len(p), -done[p][0], p))
        if not large:
            break
        if len(large[0]) >= GROUP_CHARS:
            heavy[large[0]] = done.pop(large[0])
            continue
        depth = len(large[0])
        opened = [p for p in large if len(p) == depth]
        done = {p: x for p, x in done.items() if p not in opened} | _counts(keyed, depth, opened)
    return sorted(heavy)


def _leaves(keyed: DataFrame, first: dict[str, tuple[int, int]], n_shards: int, tolerance: float, rows_per_piece: int, depth: int = 0) -> list[tuple[str, int, int]]:
    """Key prefixes in order with the exact bytes and rows under each, fine enough for the splitters and the pieces.

    A round counts, across all partitions, what lies below every probe (the next two hex digits) inside the prefixes that
    still matter: those with a wanted splitter inside, unless either end of the prefix is within tolerance or it is one group of equal
    texts, and those with more rows than a piece may have. The driver gets 256 counts for each such prefix. ``first`` are the counts below
    ``depth`` characters.
    """
    done, counted = {}, first
    while counted:
        done |= counted
        depth += ROUND_CHARS
        total, below, open_ = sum(b for b, _ in done.values()), 0, []
        wanted = [total * k / n_shards for k in range(1, n_shards)]
        slack = tolerance * total / n_shards
        for p in sorted(done):
            b, n = done[p]
            inside = len(p) < GROUP_CHARS and any(below + slack < x < below + b - slack for x in wanted)
            if len(p) == depth < KEY_CHARS and n > 1 and (inside or n > rows_per_piece):
                open_.append(p)
            below += b
        for p in open_:
            del done[p]
        counted = _counts(keyed, depth, open_) if open_ else {}
    return [(p, *done[p]) for p in sorted(done)]


def _dealt(leaves: list[tuple[str, int, int]], shards: int, first: int, rows_per_piece: int) -> list[tuple[str, int, int, int]]:
    """(prefix, shard, piece, first slot) of each leaf: a group goes, as a whole, where its middle lies."""
    total, sizes = sum(b for _, b, _ in leaves) or 1, {}
    for p, b, _ in leaves:
        sizes[p[:GROUP_CHARS]] = sizes.get(p[:GROUP_CHARS], 0) + b
    placed, below, group, shard, piece, in_piece, slot, base = [], 0, "", -1, 0, 0, 0, 0
    for prefix, _, rows in leaves:
        if prefix[:GROUP_CHARS] != group:
            below += sizes.get(group, 0)
            group = prefix[:GROUP_CHARS]
            to = first + min(shards - 1, int((below + sizes[group] / 2) * shards / total))
            if to != shard:
                shard, piece, in_piece, slot, base = to, 0, 0, 0, 0
        if in_piece and in_piece + rows > rows_per_piece:
            piece, in_piece, base = piece + 1, 0, slot
        placed.append((prefix, shard, piece, base))
        in_piece, slot = in_piece + rows, slot + rows
    return placed


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, *, doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.001, rows_per_piece: int = 1_000_000) -> DataFrame:
    """All columns of ``docs`` plus size, text_crc32, law ("bytes"), shard, slot and grown_shard (null under this law).

    size is the UTF-8 bytes of the text (null: none, and its group is that of null texts) plus 1. Equal texts always share a shard. A
    group of equal texts that has more bytes than the shards left to the others would have each has a shard to itself, with the highest
    numbers; the others fill the rest in key order, and the bytes of each of these shards differ from an equal part by at most
    ``tolerance`` of that plus half the largest group at either of its ends, since a splitter that falls inside a group moves to its nearer
    edge. slot numbers the rows of a shard from 0 without gaps, in key order; rows alike in text and id take adjacent slots in any
    order. No rows give no rows; null ids are hashed as such. Columns of ``docs`` that bear the new names are replaced.

    The keys and sizes are written once; each round of probes is a map-side-combined count over them. The last step is the only
    exchange of documents: rows go to pieces of a shard of about ``rows_per_piece`` rows (more where there would be over MAX_PIECES), whose
    first slots are known from the counts.
    """
    spark = docs.sparkSession
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keyed = docs.select(_key(text, doc_id).alias("key"), (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"))
    keyed = staged(keyed, "shard-keys")
    first = _counts(keyed, 0, [])
    rows_per_piece = max(rows_per_piece, sum(n for _, n in first.values()) // MAX_PIECES)
    heavy = _own_shard(keyed, first, n_shards)
    placed = []
    for k, group in enumerate(heavy):
        own = _leaves(keyed, _counts(keyed, GROUP_CHARS, [group]), 1, tolerance, rows_per_piece, GROUP_CHARS)
        placed += _dealt(own, 1, n_shards - len(heavy) + k, rows_per_piece)
    if heavy:
        keyed = keyed.filter(~F.substring("key", 1, GROUP_CHARS).isin(heavy))
        first = _counts(keyed, 0, [])
    rest = n_shards - len(heavy)
    placed += _dealt(_leaves(keyed, first, rest, tolerance, rows_per_piece), rest, 0, rows_per_piece)
    # a prefix may also begin the key of a group with a shard of its own; each row takes the longest that it has
    out = docs.drop(*[c for c in added if c in docs.columns]).withColumns({
        "__key": _key(text, doc_id),
        "size": (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long"),
        "text_crc32": F.crc32(F.coalesce(F.col(text), F.lit(""))).cast("long"),
    })
    out = _place(spark, out, placed)
    order = Window.partitionBy("shard", "__piece").orderBy("__key", F.col(doc_id).asc_nulls_first())
    return out.withColumns({
        "slot": (F.col("__base") + F.row_number().over(order) - 1).cast("long"),
        "law": F.lit("bytes"),
        "grown_shard": F.lit(None).cast("int"),
    }).select(*[c for c in docs.columns if c not in added], *added)


def _place(spark: SparkSession, keyed: DataFrame, placed: list[tuple[str, int, int, int]]) -> DataFrame:
    """Adds shard, piece and the piece's first slot. The leaves number 256 for each splitter and piece at most, and their lengths are few."""
    columns = ["shard", "__piece", "__base"]
    lengths = sorted({len(p) for p, *_ in placed}) or [ROUND_CHARS]
    for k in lengths:
        rows = [x for x in placed if len(x[0]) == k]
        side = spark.createDataFrame(rows, f"__p{k} string, __s{k} int, __q{k} int, __b{k} long")
        if len(rows) <= 200_000:
            side = F.broadcast(side)
        keyed = keyed.join(side, F.substring("__key", 1, k) == F.col(f"__p{k}"), "left")
    for c, letter in zip(columns, "sqb", strict=True):
        keyed = keyed.withColumn(c, F.coalesce(*[F.col(f"__{letter}{k}") for k in reversed(lengths)]))
    return keyed.drop(*[f"__{x}{k}" for k in lengths for x in "psqb"])
