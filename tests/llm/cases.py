"""Documents that the operators must handle, and plain versions of what they compute."""

import re

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i * 7 % 1013}" for i in range(3000))
LICENSE = "permission is granted to use copy and change this text for any purpose at all without any fee and with no warranty whatever it may be"
TEXTS = [
    None, "", " ", "\n\n", "one", LONG, LONG, LONG.replace("w7 ", "x "), LICENSE, LICENSE + " tail", "head " + LICENSE, (LICENSE + "\n") * 5,
    "ünï çödé 😀 ▁ text\twith\x0btabs", "a" * 5000, "ab" * 900, " ".join(["same"] * 60), "line one here\nline one here\nother line!\n\nline one here",
    "Home | About | Contact | Terms\n" + LICENSE + " and a few words more so that it stays", "WOW!! GREAT!! BUY!! NOW!! HERE!! TODAY!!\n" + LICENSE, "### $$$ %%% &&&",
    "mail a.b+c@d-e.example.org or call +1 (212) 555-0199, card 4111 1111 1111 1111, host 10.0.0.255", "x@y 1.2.3 +12 4111-1111-1111-1112 999.1.1.1", "<|endoftext|> <s> </s>", LONG[:4000] + " " + LICENSE,
]


def frame(spark, extra=True):
    """The texts with ids, each twice under different ids, and columns with clashing names. ``awkward`` has null and repeated ids."""
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, t, "de", "src1", len(t or "")) for i, t in enumerate(TEXTS)] if extra else []
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema).repartition(5)
    return df.selectExpr("*", "'x' as shard", "1 as n_words", "array(1) as bands", "'k' as chunk", "true as kept") if extra else df


def hot(spark, n=400):
    """One text in a third of all rows, and near copies of another."""
    rows = [(i, LICENSE if i % 3 == 0 else LICENSE + f" number {i % 7}" if i % 3 == 1 else f"{LONG[:900]} own{i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(t):
    return WORD.findall(t or "")


#: Two texts without a word in common, and one longer than any slice.
FIRST = " ".join(f"alpha{i % 9}x{i}" for i in range(140))
SECOND = " ".join(f"omega{i % 9}y{i}" for i in range(140))
HUGE = " ".join(f"huge{i * i % 100003}" for i in range(90_000))
AWKWARD = [
    (None, None), (None, FIRST), (None, FIRST), (1, FIRST), (1, SECOND), (2, FIRST), (3, SECOND), (3, SECOND), (4, ""), (4, ""), (5, HUGE), (6, HUGE + " tail"), (7, "short"), (7, None),
    (8, FIRST + " and more words here"), (-9, SECOND + " mail a@b.example.org, phone +1 (212) 555-0199"),
]


def awkward(spark):
    """Null ids, ids with several texts, rows alike in every column, a very long text, and columns with clashing names."""
    rows = [(i, t, "en", "src0", len(t or ""), "x", 1, [1], "k", True, 2, "h") for i, t in AWKWARD]
    names = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words int, bands array<int>, chunk string, kept boolean, size int, hash string"
    return spark.createDataFrame(rows, names).repartition(5)
