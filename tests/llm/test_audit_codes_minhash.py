"""The audit, the codes and the near-duplicate classes against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from cases import AWKWARD, awkward, frame, hot, words

from geolattice.llm import audit, codes, minhash


def rows(df):
    return [r.asDict() for r in df.collect()]


# audit


def plain_audit(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if d is not None and q == 1}, {d for d, _, x in labels if d is not None and x == 1}
    failed = []
    for d, t, part in docs:
        t = t or ""
        ws = words(t)
        own = {f for f, hit in (("A", len(ws) < 50), ("B", 100 * len(set(ws)) < 65 * len(ws)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t)), ("D", any(c in "#$%&*|" for c in t)), ("E", d is not None and first[t] < d)) if hit}
        failed.append((part or "", own, d in good, d in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {f[0] for f in failed}:
            left = [f for f in failed if f[0] == part]
            every = left
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in x[1] for x in every) - len(gone), sum(x[1] == {f} for x in every), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows(df)}


def test_swaps_visit_every_order_once():
    for n in range(1, 6):
        order, seen = list(range(n)), {tuple(range(n))}
        for at in audit.swaps(n):
            order[at], order[at + 1] = order[at + 1], order[at]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(n) == len(audit.swaps(n)) + 1


@pytest.mark.parametrize("make", [frame, awkward])
def test_audit_against_each_order(spark, make):
    docs = make(spark).withColumn("source", __import__("pyspark").sql.functions.expr("nullif(source, 'src1')"))
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 120, 2)] + [(1, None, 1), (1, 1, None), (None, 1, 1), (3, 0, 0), (3, 0, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in rows(docs)], labels)
    assert audited(audit.audit_filters(docs, known)) == want


def test_audit_of_nothing(spark):
    docs, known = awkward(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not rows(audit.audit_filters(docs.limit(0), known))
    assert all(v[4] == v[5] == 0 for v in audited(audit.audit_filters(docs, known)).values())


def test_audit_keeps_no_rows_of_hot_parts(spark):
    docs = hot(spark).selectExpr("*", "case when doc_id % 3 = 0 then 'hot' else 's' || doc_id % 90 end as source")
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in rows(docs)], [])
    got = audited(audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got == want and len({k[0] for k in got}) > 60


# codes


def plain_codes(vectors):
    """vectors: (vec_id, components, label); whole rows of the expected result."""
    fine = lambda v: v and len(v) % 16 == 0 and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in vectors if fine(v)]
    lead = sorted((x for x in kept if x[0] is not None), key=lambda x: (x[0], x[1]))
    kept = [x for x in kept if len(x[1]) == len(lead[0][1])]
    lead = [x for x in lead if len(x[1]) == len(lead[0][1])]
    w = len(lead[0][1]) // 16
    cut = lambda v: [v[p * w : p * w + w] for p in range(16)]
    books = [[cut(x[1])[p] for x in lead[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        mine = defaultdict(list)
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                mine[p, near(part, p)[1]].append(part)
        for (p, k), parts in mine.items():
            books[p][k] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, [near(part, p) for p, part in enumerate(cut(v))], l) for i, v, l in kept]
    errors = [sum(d for d, _ in found) for _, found, _ in coded]
    by = Counter()
    for (_, _, l), e in zip(coded, errors, strict=True):
        by[l] += e
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), e, by[l], digest) for (i, found, l), e in zip(coded, errors, strict=True)), key=str)


def vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16 * width)], int(i % 4) if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize("width", [1, 4, 6])
def test_codes_against_plain_search(spark, width):
    own = vectors(220, width)
    own += [(1000 + i, v, 9) for i, v, _ in own[:9]]  # rows alike but for their id
    own += [(-5, None, 1), (-4, [], 1), (-3, [None] * (16 * width), 1), (-2, [float("nan")] * (16 * width), 2), (-1, [float("inf")] * (16 * width), None), (2000, [0.5] * (16 * width + 16), 1), (2001, [0.5] * 7, 1), (None, own[3][1], 3), (7, own[8][1], 3), (7, own[8][1], 3)]
    df = spark.createDataFrame(own, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as code", "1 as error", "2 as n").repartition(5)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in rows(codes.compress_vectors(df))), key=str)
    assert got == plain_codes(own)


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, label string"
    few = vectors(5, 2)
    got = rows(codes.compress_vectors(spark.createDataFrame([(i, v, None) for i, v, _ in few], schema)))
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == [(i, f"{i:02x}" * 16, 0, 0) for i in range(5)]
    for none in ([], [(None, [0.5] * 32, "a")], [(1, None, "a")]):
        assert not rows(codes.compress_vectors(spark.createDataFrame(none, schema)))


def test_bounds_lose_no_nearest_entry():
    rng = np.random.default_rng(3)
    for width in (1, 2, 4, 8, 12, 5):
        x, book = rng.integers(-40, 40, (3000, width)), rng.integers(-40, 40, (64, width))
        book[10] = book[40]  # ties go to the lower index
        x[:64] = book
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        at, least = codes.nearest_entries(x, book)
        assert (at == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        large = rng.integers(-(1 << 28), 1 << 28, (200, width))
        at, least = codes.nearest_entries(large, large[:64])
        d = ((large[:, None] - large[None, :64]) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_codes_without_a_broadcast(spark, monkeypatch):
    own = vectors(100, 4)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    got = rows(codes.compress_vectors(spark.createDataFrame(own, "vec_id long, embedding array<float>, label int")))
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got), key=str) == plain_codes(own)


# near-duplicate classes


def shingles(t):
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(ws[i : i + min(len(ws), 5)]) for i in range(max(len(ws) - 4, 1))) if ws else frozenset()


def plain_classes(docs, percent=85):
    """docs: (doc_id, text). Sorted (doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in docs]
    different = sorted({s for d, s in zip((d for d, _ in docs), sets, strict=True) if s and d is not None}, key=len)
    parent = {s: s for s in different}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if 100 * len(a) < percent * len(b):
                break
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                parent[find(a)] = find(b)
    least = {}
    for (d, _), s in zip(docs, sets, strict=True):
        if s and d is not None:
            least[find(s)] = min(least.get(find(s), d), d)
    name = lambda d, s: None if d is None else least[find(s)] if s else d
    return sorted(((d, len(s), name(d, s), d is None or name(d, s) == d) for (d, _), s in zip(docs, sets, strict=True)), key=str)


def classed(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(minhash.minhash_classes(df))), key=str)


@pytest.mark.parametrize("make", [frame, awkward, hot])
def test_classes_against_all_pairs(spark, make):
    docs = make(spark)
    assert classed(docs) == plain_classes([(r["doc_id"], r["text"]) for r in rows(docs)])


def test_classes_of_no_rows(spark):
    assert not classed(awkward(spark).limit(0))
    assert classed(spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "a b c"), (None, "a b")], "doc_id long, text string")) == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (None, 1, None, True)], key=str)


def family(n, seed=5):
    """Chains of texts that lie about the threshold: each changes a few words of one before it."""
    rng = np.random.default_rng(seed)
    texts = [[f"w{k}" for k in rng.integers(0, 5000, 90)]]
    for i in range(1, n):
        t = list(texts[int(rng.integers(max(0, i - 12), i))])
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, len(t)))] = f"x{int(rng.integers(0, 10**6))}"
        texts.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_classes_of_a_family_in_many_blocks(spark, monkeypatch):
    # blocks of ten, two pivots: most of the work is across blocks
    docs = family(300) + [(1000 + i, t) for i, t in family(40, 6)]
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 10)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    got = classed(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert got == plain_classes(docs) and len({g[2] for g in got}) > 1


def test_cells_of_an_alike_group_grow_with_it(spark):
    # all of a group but a few in one class: rows of cells follow the group's size, not its square
    def cells(n):
        members = spark.range(n).selectExpr("1L as g", "id as node", "1 as bytes")
        classes = spark.range(n).filter(f"id < {n} - 50").selectExpr("1L as g", "id as node", "0L as component")
        return sum(len(r["cells"]) for r in minhash._within(members, "g").collect()), sum(len(r["cells"]) for r in minhash._across(members, "g", classes).collect())

    small, large = cells(20_000), cells(80_000)
    assert large[0] <= 4.4 * small[0] and large[1] <= 4.4 * small[1]


def test_cells_bring_all_unjoined_pairs_together(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    members = spark.range(60).selectExpr("1L as g", "id as node", "1 as bytes")
    classes = spark.range(60).selectExpr("1L as g", "id as node", "case when id < 25 then 0 when id < 40 then 25 else id end as component")
    of = {r["node"]: r["component"] for r in classes.collect()}
    side = defaultdict(lambda: ([], []))
    for r in minhash._across(members, "g", classes).collect():
        for c in r["cells"]:
            side[c["kind"], c["lo"], c["hi"]][c["side"]].append(r["node"])
    met = {frozenset(p) for a, b in side.values() for p in (combinations(a, 2) if not b else ((x, y) for x in a for y in b))}
    assert {frozenset(p) for p in combinations(range(60), 2) if of[p[0]] != of[p[1]]} <= met


def test_awkward_has_what_it_says():
    assert any(d is None for d, _ in AWKWARD) and max(len(t or "") for _, t in AWKWARD) > 500_000
