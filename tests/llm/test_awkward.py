"""Every operator and pipeline stage on null and repeated ids, rows alike, very long texts and columns with clashing names."""

import hashlib
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from geolattice.llm import decontamination, jaccard, pieces, pii, quality, sharding, substrings, suffixes, text, tokenfiles, toxicity, wordcache
from geolattice.llm.session import vocabulary

ROWS = Counter(cases.AWKWARD)


@pytest.fixture(scope="module")
def docs(spark):
    return cases.awkward(spark)


def ids(df, *more):
    return Counter(tuple(r[c] for c in ("doc_id", *more)) for r in df.select("doc_id", *more).collect())


IDS = Counter((i,) for i, _ in cases.AWKWARD)


def test_row_wise_operators(docs, spark):
    assert ids(quality.clean_lines(docs), "text") == ROWS
    assert ids(pii.find_personal_data(docs), "text") == ROWS
    items = spark.createDataFrame([("a", cases.FIRST[:200]), (None, cases.SECOND[:300]), ("b", None)], "item_id string, text string")
    found = decontamination.find_benchmark(docs, items)
    assert ids(found, "text") == ROWS
    # an item with a null id is hit, but has no id to list
    assert ids(found.filter("doc_id = 1"), "n_items", "contaminated") == Counter({(1, 1, True): 1, (1, 0, True): 1})
    assert found.filter("contaminated").count() == 9 and found.filter("text is null and (n_words <> 0 or clean_text is not null)").isEmpty()
    assert ids(pieces.encode_pieces(docs, vocabulary("piece_bpe_32k.model"), digest=True).filter("lossless"), "text") == ROWS


def test_a_pass_of_many_blocks(docs, spark):
    items = spark.createDataFrame([(f"i{k:02}", " ".join(cases.FIRST.split()[k * 5 : k * 5 + 12])) for k in range(20)], "item_id string, text string")
    one, many = (decontamination.find_benchmark(docs, items, block_bytes=b, pass_bytes=p) for b, p in ((1 << 20, 1 << 20), (300, 900)))
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "clean_text")
    assert ids(one, *columns) == ids(many, *columns)


def test_toxicity_and_sharding(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (5, 0), (5, 1)], "doc_id long, toxic int")
    assert ids(toxicity.score_toxicity(docs, labels)) == IDS
    out = sharding.shard_by_bytes(docs, 8).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == ROWS
    for t in {r["text"] for r in out}:
        assert len({r["shard"] for r in out if r["text"] == t}) == 1
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_repeats(docs):
    low = float("-inf")
    first = {}
    for i, t in cases.AWKWARD:
        w = cases.words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, float("inf")), low if i is None else i)
    want = Counter()
    for i, t in cases.AWKWARD:
        w = cases.words(t)
        gone = {k for a in range(len(w) - 12) if first[tuple(w[a : a + 13])] < (low if i is None else i) for k in range(a, a + 13)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert ids(substrings.drop_repeated_passages(docs, chunk_bytes=100_000), "n_words", "n_removed", "kept_sha256") == want
    count = Counter()
    raws = [(i, (t or "").encode()) for i, t in cases.AWKWARD]
    for _, b in raws:
        count.update(hashlib.md5(b[k : k + 400]).digest() for k in range(len(b) - 399))
    want = Counter()
    for i, b in raws:
        gone, reach = 0, 0
        for k in range(len(b)):
            if k + 400 <= len(b) and count[hashlib.md5(b[k : k + 400]).digest()] > 1:
                reach = k + 400
            gone += k < reach
        want[i, len(b), gone] += 1
    assert ids(suffixes.drop_repeated_strings(docs, chunk_bytes=100_000), "n_bytes", "n_removed") == want


def test_anchors_do_not_depend_on_the_step(monkeypatch):
    s = next(text.slices(pa.array([cases.HUGE[:60_000], cases.FIRST, cases.HUGE[100:50_000]], pa.large_string()), 1 << 20))
    whole = suffixes._Anchors(s, 400)
    monkeypatch.setattr(suffixes, "STEP", 777)
    parts = suffixes._Anchors(s, 400)
    assert all((getattr(whole, k) == getattr(parts, k)).all() for k in ("at", "hash", "low", "high")) and len(whole.at) > 500


def test_texts_that_share_an_id(docs):
    key = lambda t: hashlib.sha256(t.encode()).hexdigest()[:32]
    found = jaccard.near_duplicates(docs)
    assert ids(found) == IDS
    by = ids(found.filter("doc_id in (1, 2, 3)"), "text_id", "class_id", "class_key")
    assert by == Counter({(1, 1, 1, key(cases.FIRST)): 1, (2, 1, 1, key(cases.FIRST)): 1, (1, 1, -9, key(cases.SECOND + " mail a@b.example.org, phone +1 (212) 555-0199")): 1, (3, 1, -9, key(cases.SECOND + " mail a@b.example.org, phone +1 (212) 555-0199")): 2})
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect())
    assert kept == Counter({(1, cases.FIRST): 1, (-9, cases.AWKWARD[-1][1]): 1, (5, cases.HUGE): 1, (7, "short"): 1, (4, ""): 2, (7, None): 1, (None, None): 1, (None, cases.FIRST): 2})


def test_two_texts_of_one_id_both_stay(spark):
    table = spark.createDataFrame([(1, cases.FIRST), (1, cases.SECOND), (2, cases.FIRST), (3, cases.SECOND)], "doc_id long, text string")
    assert Counter((r[0], r[1]) for r in jaccard.one_of_each(table).collect()) == Counter({(1, cases.FIRST): 1, (1, cases.SECOND): 1})


def test_token_files(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = tokenfiles.read_tokens(tokenfiles.write_tokens(docs, vocabulary("byte_bpe_50k.json"), file_bytes=5000)).collect()
    want = Counter()
    for i, t in cases.AWKWARD:
        x = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: float("-inf") if i is None else i)


def test_ids_of_large_vocabularies():
    cache = wordcache.WordCache()
    keys = np.arange(5, dtype=np.uint64)
    encode = lambda where: (np.array([70_000, 4_000_000_000, 3])[: len(where)], np.ones(len(where), np.int64))
    assert cache.lookup(keys[:3], keys[:3], encode)[0].tolist() == [70_000, 4_000_000_000, 3]
    with pytest.raises(ValueError, match="32 bits"):
        cache.lookup(keys[3:], keys[3:], lambda where: (np.array([1 << 33, -1]), np.ones(2, np.int64)))


def test_pipeline_stages(docs, spark):
    import corpus_pipeline

    df = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, "/root/testdata/sf0.001")
        assert df.columns == docs.columns
    corpus_pipeline.STAGES[-1][1](spark, df, "/root/testdata/sf0.001").collect()
    assert Counter((r["doc_id"], r["kept"]) for r in df.select("doc_id", "kept").collect())[1, True] == 1
