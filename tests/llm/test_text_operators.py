"""Each operator against a plain version, on odd texts, a hot group and an empty table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pyarrow as pa
import pytest
from geolattice.llm import decontamination, jaccard, quality, sharding, substrings, suffixes, toxicity
from geolattice.llm import text as T

SMALL = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(params=["odd", "hot", "empty", "table"])
def docs(request, spark):
    odd = cases.frame(spark)
    return {"odd": lambda: odd, "hot": lambda: cases.hot(spark), "empty": lambda: odd.limit(0), "table": lambda: spark.read.parquet(f"{SMALL}/documents.parquet")}[request.param]()


def test_sharding(docs):
    out = rows(sharding.shard_by_bytes(docs.select("doc_id", "text", *[c for c in docs.columns if c == "shard"]), 8))
    given = {r["doc_id"]: r["text"] for r in rows(docs)}
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in rows(docs))
    by = defaultdict(list)
    for r in out:
        raw = (given[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        by[r["shard"]].append(r)
    for s, own in by.items():
        assert 0 <= s < 8 and sorted(r["slot"] for r in own) == list(range(len(own)))
    groups, sizes = defaultdict(set), Counter()
    for r in out:
        groups[given[r["doc_id"]]].add(r["shard"])
        sizes[given[r["doc_id"]]] += r["size"]
    assert all(len(x) == 1 for x in groups.values())
    total, rest, own = sum(sizes.values()), sum(sizes.values()), 0
    for x in sorted(sizes.values(), reverse=True):  # groups too large for a shard have one each
        if own < 7 and x > rest / (8 - own):
            own, rest = own + 1, rest - x
    if out:
        light = sorted(sizes.values(), reverse=True)[own]
        assert all(abs(sum(r["size"] for r in by[s]) - rest / (8 - own)) <= light + 0.001 * total for s in range(8 - own))


def test_sharding_of_large_groups(spark):
    texts = [("x" * 90, 400), ("y" * 50, 300), ("z", 900)] + [(f"own {i} " + "w" * 20, 1) for i in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(t for t, n in texts for _ in range(n))], "doc_id long, text string")
    out = rows(sharding.shard_by_bytes(docs, 8, rows_per_piece=64))
    shard = defaultdict(set)
    for r in out:
        shard[r["text"][:1]].add(r["shard"])
    assert shard["x"] == {7} or shard["x"] == {6}
    assert len(shard["x"]) == len(shard["y"]) == 1 and not shard["x"] & shard["y"] and not (shard["x"] | shard["y"]) & shard["o"]
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_quality(docs):
    for r in rows(quality.clean_lines(docs.select("doc_id", "text", *[c for c in docs.columns if c == "n_words"]))):
        t = r["text"] or ""
        w, lines = cases.words(t), t.split("\n")
        seen, dup = set(), 0
        for x in lines:
            if cases.words(x):
                dup += x in seen
                seen.add(x)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
        assert len(cases.words(r["cleaned_text"])) == len(w) - r["n_lost_words"]


def test_line_rules(spark):
    body = "\n".join(" ".join(f"plain{i}x{k} word" for k in range(6)) for i in range(9))
    junk = ["Home | About | Contact | Terms", "BUY!! NOW!! GREAT!! WOW!! YES!!", "a### b$$$ c%%% d&&&", "click here to subscribe", "no no no no no no no no no no no"]
    out = rows(quality.clean_lines(spark.createDataFrame([(i, f"{j}\n{body}") for i, j in enumerate(junk)] + [(9, body), (10, "\n".join(junk * 2))], "doc_id long, text string")))
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["cleaned_text"] == body and by[i]["kept"] and by[i]["n_bad_lines"] == 1 for i in range(5))
    assert by[9]["n_bad_lines"] == 0 and by[9]["kept"] and not by[10]["kept"]


def test_lines_of_the_corpus(spark):
    # a line that stands between ever different lines goes; lines of many copies and of near copies stay; so do long passages
    own = lambda i, k: " ".join(f"w{i}x{k}x{j}" for j in range(9)) + "."
    page = lambda i, *more: "\n".join([own(i, 0), own(i, 1), own(i, 2), *more, own(i, 3), own(i, 4), own(i, 5)])
    passage = " ".join(f"passage{k}" for k in range(40)) + "."
    texts = [page(i, "Alle Rechte vorbehalten, mit Quelle.") for i in range(40)] + [page(100, "copied")] * 50 + [page(200) + f"\nedit {i}." for i in range(50)] + [page(300 + i, passage) for i in range(40)]
    menu = "Start\nTopics\n\nOur team\nContact us\n" + page(900)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, menu, "", None])], "doc_id long, text string").repartition(7)
    by = {r["doc_id"]: r for r in rows(quality.clean_lines(docs))}
    assert all(by[i]["n_bad_lines"] == 1 and "Rechte" not in by[i]["cleaned_text"] and by[i]["kept"] for i in range(40))
    assert all(by[i]["n_bad_lines"] == 0 and by[i]["kept"] for i in range(40, 180))
    assert by[180]["n_bad_lines"] == 4 and by[180]["kept"] and by[180]["cleaned_text"].strip() == page(900)
    assert not by[181]["kept"] and not by[182]["kept"]
    assert len(quality.boilerplate(docs.limit(0))) == 0


def test_a_long_list_of_boilerplate_is_joined_with_the_same_result(spark, monkeypatch):
    own = lambda i, k: " ".join(f"w{i}x{k}x{j}" for j in range(9)) + "."
    texts = ["\n".join([own(i, 0), own(i, 1), own(i, 2), f"Notice {i % 2}", own(i, 3), own(i, 4), own(i, 5)]) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[0], "", None])], "doc_id long, text string").repartition(5)
    one = sorted(map(str, quality.clean_lines(docs).collect()))
    assert sum("n_bad_lines=1" in r for r in one) == 62
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert sorted(map(str, quality.clean_lines(docs).collect())) == one


def test_stops_are_whole_characters_and_phrases_make_short_lines_bad_only(spark):
    body = "\n".join(" ".join(f"plain{i}x{k} word" for k in range(6)) + "." for i in range(9))
    menu = lambda end: f"Eins {end}\nZwei {end}\nDrei {end}\n" + body
    long = " ".join(f"said{i}" for i in range(30)) + " terms of use " + " ".join(f"more{i}" for i in range(30)) + "."
    texts = [menu(x) for x in ("weiss", "weiß", "æ", "û", "Á", "Â")] + [menu(x) for x in ("aus.", "aus…", "»", "aus。")] + [long + "\n" + body]
    by = {r["doc_id"]: r for r in rows(quality.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    assert [by[i]["n_bad_lines"] for i in range(11)] == [3] * 6 + [0] * 5


def normal(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(docs, spark):
    own = docs.select("doc_id", "text", *[c for c in docs.columns if c == "n_words"])
    items = [("b", cases.LICENSE.upper()), ("a", "one"), ("c", " ".join(cases.LONG.split()[5:40])), ("d", None), ("e", "..."), ("a2", "Ünï çödé"), ("f", "same same same")]
    if "lang" in docs.columns and "shard" not in docs.columns:
        items += [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").selectExpr("cast(item_id as string)", "text").collect()]
    table = spark.createDataFrame(items, "item_id string, text string")
    windows = defaultdict(set)
    for k, t in items:
        w = normal(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(k)
    sizes = {len(x) for x in windows}
    for limit in (1 << 20, 400):  # one block, and several
        for r in rows(decontamination.find_benchmark(own, table, block_bytes=limit)):
            w = normal(r["text"])
            hit, found = set(), set()
            for n in sizes:
                for i in range(len(w) - n + 1):
                    if own_ := windows.get(tuple(w[i : i + n])):
                        hit |= set(range(i, i + n))
                        found |= own_
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
            assert r["items_sha256"] == sha(",".join(sorted(found)).encode())
            assert len(normal(r["clean_text"])) == len(w) - len(hit)


def test_repeated_passages(docs):
    given = sorted(((r["doc_id"], r["text"]) for r in rows(docs)))
    first = {}
    for d, t in given:
        w = cases.words(t)
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    want = {}
    for d, t in given:
        w = cases.words(t)
        gone = {k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(i, i + 13)}
        want[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone).encode()))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substrings.drop_repeated_passages(docs, chunk_bytes=20_000))}
    assert got == want


def test_repeated_strings(docs):
    given = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in rows(docs)))
    n = 400
    count = Counter(b[i : i + n] for _, b in given for i in range(len(b) - n + 1))
    for hot in (suffixes.HOT, 3):
        got = {r["doc_id"]: r for r in rows(suffixes.drop_repeated_strings(docs, chunk_bytes=20_000, hot=hot))}
        assert len(got) == len(given)
        assert_strings(given, count, got, n)


def assert_strings(given, count, got, n):
    for d, b in given:
        gone, reach = bytearray(len(b)), 0
        for i in range(len(b)):
            if i + n <= len(b) and count[b[i : i + n]] > 1:
                reach = i + n
            gone[i] = i < reach
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))


def shingles(t):
    w = cases.words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def test_near_duplicates(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 32)
    given = {r["doc_id"]: r["text"] for r in rows(docs)}
    least = {}
    for d in sorted(given):
        if cases.words(given[d]):
            least.setdefault(given[d], d)
    sets = {d: shingles(t) for t, d in least.items()}
    by = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    links, parent = Counter(), {d: d for d in given}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in set().union(*[by[x] for x in sets[a]]):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links.update((a, b))
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    for r in rows(jaccard.near_duplicates(docs)):
        d, t = r["doc_id"], given[r["doc_id"]]
        rep = least.get(t, d) if cases.words(t) else d
        assert (r["text_id"], r["class_id"], r["n_links"]) == (rep, find(rep), links[rep]), d


def test_toxicity(spark):
    tables = [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]
    done = toxicity.score_toxicity(*tables).join(tables[1].select("doc_id", "toxic"), "doc_id").toPandas()
    held = done[done.held_out]
    assert (held.held_out == held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert ((held.predicted == held.toxic).mean() > 0.95) and (held[held.toxic == 1].score.mean() > 0.4 > held[held.toxic == 0].score.mean())


def test_toxicity_finds_most_and_flags_no_others(spark):
    tables = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    done = toxicity.score_toxicity(*tables).join(tables[1].select("doc_id", "toxic"), "doc_id").toPandas()
    held = done[done.held_out]
    found = held[held.predicted == 1]
    assert held.toxic.sum() > 80 and found.toxic.sum() >= 0.9 * held.toxic.sum() and found.toxic.mean() >= 0.97


def plain_log_ratio(docs, labels, discount=toxicity.DISCOUNT):
    """The whole-text log-likelihood ratio for each word, counted and smoothed with dictionaries."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    cut = lambda w: w.encode()[: toxicity.PREFIX]
    expressions = lambda ws: {("", cut(w)) for w in ws} | {(cut(w), w) for w in ws}
    shared = Counter(e for t in {t for _, t in docs if t is not None} for e in expressions(split(t)))
    below = Counter()
    for (p, _), n in shared.items():
        below[p] += n
    own, total, left = (defaultdict(Counter) for _ in range(3))
    for t, y in {(t, labels[d]) for d, t in docs if labels.get(d) is not None and zlib.crc32(str(d).encode()) % 5}:
        ws = split(t)
        own[y].update(expressions(ws) | {(("after", a), b) for a, b in zip(ws[:-1], ws[1:], strict=True)})
    for y in (0, 1):
        for (p, _), n in own[y].items():
            total[y][p] += n
            left[y][p] += min(n, discount)

    def smoothed(y, p, c, back):
        if total[y][p] == 0:
            return back
        return (max(own[y][p, c] - discount, 0) + left[y][p] * back) / total[y][p]

    def ratio(p, c, backs, both):
        # without evidence it is what the classes leave for unseen ones, if both know the parent
        if max(own[0][p, c], own[1][p, c]) > discount:
            return math.log(smoothed(1, p, c, backs[1]) / smoothed(0, p, c, backs[0]))
        known = total[0][p] and total[1][p]
        return both + (math.log(left[1][p] / total[1][p]) - math.log(left[0][p] / total[0][p]) if known else 0.0)

    def alone(y, w):
        step = lambda p, c: smoothed(y, p, c, shared[p, c] / below[p])
        return step("", cut(w)) * step(cut(w), w)

    out = {}
    for d, t in docs:
        ws, sum_ = split(t), 0.0
        for k, w in enumerate(ws):
            base = lambda p, c: [shared[p, c] / below[p]] * 2
            r = ratio("", cut(w), base("", cut(w)), 0.0) + ratio(cut(w), w, base(cut(w), w), 0.0)
            sum_ += ratio(("after", ws[k - 1]), w, [alone(0, w), alone(1, w)], r) if k else r
        out[d] = sum_ / len(ws) if ws else 0.0
    return out


def test_toxicity_against_plain_models(spark):
    # words that are ordinary one by one and toxic one behind the other
    kind = lambda i: "you total fool go away" if i % 2 else "the total went to a fool you know"
    docs = [(i, f"{kind(i)} w{i % 5} w{i % 7} word{i % 3} {'Über alles' if i % 4 else 'total'} x{i}") for i in range(120)] + [(200, ""), (201, None), (202, "fool total")]
    labels = {i: i % 2 for i in range(120)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r["doc_id"]: r["log_ratio"] for r in toxicity.score_toxicity(frame, known).collect()}
    want = plain_log_ratio(docs, labels)
    assert got == pytest.approx(want, abs=1e-4) and max(got.values()) > 0.5 > -0.2 > min(got.values())


def test_toxicity_of_odd_texts(docs, spark):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    out = rows(toxicity.score_toxicity(docs, labels))
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    none = rows(toxicity.score_toxicity(docs, labels.limit(0)))
    assert len({r["score"] for r in none}) <= 1


def test_toxicity_counts_different_texts(spark):
    # a phrase always in the same context, in many different texts, is evidence; one text in many copies is not
    ordinary = lambda i: " ".join(f"v{i * 31 % 211} w{(i * i + k) % 97}" for k in range(12))
    phrase = [(i, f"grim zorblax deed {ordinary(i)}" if i % 2 else ordinary(i), i % 2) for i in range(300)]
    docs = spark.createDataFrame(phrase, "doc_id long, text string, toxic int").repartition(5)
    held = [r for r in rows(toxicity.score_toxicity(docs, docs)) if r["held_out"]]
    assert len(held) > 30 and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    copies = spark.createDataFrame([(f"grim zorblax deed {i % 3}", 1, 1 + i % 4) for i in range(300)] + [(ordinary(0), 0, 1)], "text string, cls int, part int").repartition(5)
    assert all(not len(m.keys) for m in toxicity._fit(copies, copies, 3))
    # each class counts what rows outside the part left out have; all texts are counted once
    counted = Counter(r["text"] for r in rows(toxicity._texts(copies.unionByName(copies.selectExpr("null as text", "0 as cls", "1 as part")))))
    assert counted == Counter({r["text"] for r in rows(copies)})


def test_only_expressions_that_may_be_evident_are_counted_one_by_one(spark):
    # 400 texts of words of their own, and a phrase that four of class 1 have
    texts = [(" ".join(f"w{k}x{i}" for i in range(30)) + (" same old phrase" if k < 4 else ""), int(k < 4), 1 + k % 4) for k in range(400)]
    labelled = spark.createDataFrame(texts, "text string, cls int, part int")
    often = toxicity._often(labelled, 3, 20)
    s = next(iter(T.slices(pa.array([t[0] for t in texts]))))
    doc, parent, child = toxicity._document_counts(s, True)
    named = toxicity._with_rest(often, 20, parent, child)
    count = Counter(zip((doc < 4).tolist(), parent.tolist(), child.tolist(), strict=True))
    evident = np.array([count[d, p, c] > 3 for d, p, c in zip((doc < 4).tolist(), parent.tolist(), child.tolist(), strict=True)])
    assert evident.any() and (named == child)[evident].all() and (named == toxicity.REST).mean() > 0.8
