"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Generators of high recall propose overlapping spans; features of a span's format and of the text before it are read from each;
boosted trees score them, and thresholds calibrated for precision select what is redacted besides the spans of the fixed
patterns. The trees are fitted to a bounded table of formats, written below as recipes, and become nested CASE expressions, so
that a document is judged in one projection, without an exchange and without leaving the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in order, each with its pattern. Groups are possessive and starts stand at the edge of a run (or behind a match), which
#: changes no match and keeps the time in proportion to the text.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be worth running.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]", "number": r"[0-9][\x20().\-/]{0,2}[0-9][\x20().\-/]{0,2}[0-9]", "address": r"\W(?i:at|dot)\W", "secret": r"[0-9A-Za-z+/_=\-]{20}"}
#: The generators: numbers of seven digits or more in any grouping, addresses in words, and long strings with digits.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+(?![0-9A-Za-z])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({](?i:at)[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?i:dot)[\])}])\x20?[A-Za-z0-9-]++)++",
    "secret": r"(?<![0-9A-Za-z+/_=\-])(?=[A-Za-z+/_=\-]*+[0-9])[0-9A-Za-z+/_=\-]{20,}+",
}
KINDS = [*PATTERNS, *GENERATORS]
TRIGGERS = {
    "call": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)\b[^0-9A-Za-z]{0,4}(?:(?:at|me|us|on|no|number|is)[^0-9A-Za-z]{1,3}){0,3}$",
    "pay": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|cc|pan)\b[^0-9A-Za-z]{0,4}(?:(?:no|number|is|ending)[^0-9A-Za-z]{1,3}){0,3}$",
    "key": r"(?i)(?:token|secret|passwd|password|pwd|api_?key|apikey|access_?key|auth|bearer)[\"']?\s*(?:[:=]|is)?\s*[\"']?$",
    "other": r"(?i)\b(?:isbn|order|invoice|page|pages|version|ref|id|item|sku|commit|sha|build|ticket|year|years|since|total|patent)\b[^0-9A-Za-z]{0,4}$",
}
#: Matches of a text that are placed one behind the other.
PLACED = 128
#: Stands for no value where the highest is sought; code points of a piece that a text is cut into before spans are cut from it.
LOWEST, PIECE = -(2**31 - 1), 1024
CONTEXT, FEATURES = 28, ["n", "digits", "letters", "capitals", "seps", "groups", "plus", "paren", "kinds", "hex", "luhn", "dated", *TRIGGERS, *[f"is_{g}" for g in GENERATORS]]
#: Rows of each recipe in the table of formats; precision that the calibrated thresholds reach on the rows kept apart.
ROWS, TREES, DEPTH, PRECISION = 60, 16, 4, 0.995


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression inside a lambda would be computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / PLACED).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * PLACED + 1, F.lit(PLACED)))


def _matches(text: Column, pattern: str, hint: str, kind: str) -> Column:
    """Matches of a pattern, leftmost and not overlapping: array of (start, kind, end, match, before), in code points."""
    k = KINDS.index(kind)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string,before:string>>")

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        z = a + F.length(x["m"])
        one = F.struct(a.alias("start"), F.lit(k).alias("kind"), z.alias("end"), x["m"].alias("match"), F.right(x["g"], F.lit(CONTEXT)).alias("before"))
        return F.struct(z.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step)["out"]

    # a list grows by being copied, so the matches of a text with many are placed in blocks, each from its own start
    length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["m"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def starts(blocks: Column) -> Column:
        return F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    def paired(found: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def every(pairs: Column) -> Column:
        many = _with(_blocks(pairs), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), placed)))
        return F.when(F.size(pairs) <= PLACED, placed(pairs, F.lit(0))).otherwise(many)

    return F.when(text.rlike(hint), _with(_with(F.regexp_extract_all(text, F.lit(pattern), 0), paired), every)).otherwise(none)


def _highest_before(items: Column, value) -> Column:
    """For each item the highest value of those in front of it, LOWEST for the first; in blocks, as above."""
    ints = F.array().cast("array<int>")

    def scan(block: Column, top: Column) -> Column:
        first = F.struct(top.alias("top"), ints.alias("out"))
        return F.aggregate(block, first, lambda acc, x: F.struct(F.greatest(acc["top"], value(x)).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out")))["out"]

    def tops(blocks: Column) -> Column:
        highest = lambda block: F.aggregate(block, F.lit(LOWEST), lambda top, x: F.greatest(top, value(x)))
        first = F.struct(F.lit(LOWEST).alias("top"), ints.alias("out"))
        return F.aggregate(blocks, first, lambda acc, b: F.struct(F.greatest(acc["top"], highest(b)).alias("top"), F.concat(acc["out"], F.array(acc["top"])).alias("out")))["out"]

    return _with(_blocks(items), lambda blocks: F.flatten(F.zip_with(blocks, tops(blocks), scan)))


def _free(base: Column, proposed: Column) -> Column:
    """The proposals that overlap no base span. Few are compared one by one; many are put in one order with the base spans, where a
    proposal overlaps one if some base span in front of it ends behind its start, or some behind it starts in front of its end."""
    is_base = lambda x: x["kind"] < len(PATTERNS)
    one_by_one = F.filter(proposed, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    wide = F.transform(base, lambda b: F.struct(b["start"], b["kind"], b["end"], F.lit("").alias("match"), F.lit("").alias("before")))

    def merged(all_: Column) -> Column:
        end_before = _highest_before(all_, lambda x: F.when(is_base(x), x["end"]).otherwise(F.lit(LOWEST)))
        start_behind = F.reverse(_highest_before(F.reverse(all_), lambda x: F.when(is_base(x), -x["start"]).otherwise(F.lit(LOWEST))))
        around = F.zip_with(end_before, start_behind, lambda e, s: F.struct(e.alias("e"), (-s).alias("s")))
        both = F.zip_with(all_, around, lambda x, a: F.struct(x.alias("x"), a.alias("a")))
        return F.transform(F.filter(both, lambda y: ~is_base(y["x"]) & (y["a"]["e"] <= y["x"]["start"]) & (y["a"]["s"] >= y["x"]["end"])), lambda y: y["x"])

    few = F.size(base) * F.size(proposed).cast("long") <= PLACED * PLACED
    return F.when(few, one_by_one).otherwise(_with(F.array_sort(F.concat(wide, proposed)), merged))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, r"[^0-9]", "")
    if kind == "ip":
        return F.forall(F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _features(m: Column, before: Column, kind: Column) -> Column:
    """A struct of FEATURES for a span, the text before it and its generator's place in KINDS."""
    digits = F.regexp_replace(m, r"[^0-9]", "")
    number = lambda c: c.cast("double")
    count = lambda keep: number(F.length(F.regexp_replace(m, f"[^{keep}]", "")))
    size = F.length(digits)
    values = {
        "n": number(F.length(m)), "digits": number(size), "letters": count("A-Za-z"), "capitals": count("A-Z"), "seps": number(F.length(m)) - count("0-9A-Za-z"),
        "groups": number(F.size(F.filter(F.split(m, r"[^0-9]+"), lambda x: x != ""))), "plus": number(m.startswith("+")), "paren": number(m.contains("(")),
        "kinds": number(F.size(F.array_distinct(F.split(m, "")))), "hex": number(m.rlike("^[0-9a-f]+$")), "luhn": number(size.between(12, 19) & _luhn(digits)),
        "dated": number(m.rlike(r"(?:^|[^0-9])(?:1[5-9]|20)[0-9]{2}[-/. ](?:0?[1-9]|1[0-2])[-/. ](?:0?[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)")),
    } | {t: number(before.rlike(p)) for t, p in TRIGGERS.items()} | {f"is_{g}": number(kind == KINDS.index(g)) for g in GENERATORS}
    return F.struct(*[F.coalesce(values[f], F.lit(0.0)).alias(f) for f in FEATURES])


def _recipes(spark: SparkSession) -> DataFrame:
    """The table of formats: (kind, match, before, label), ROWS rows of each recipe, from the hash of a row's number."""
    nine = lambda i, n, salt: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt), F.lit(i)), F.lit(10**n)).cast("string"), n, "0")
    h = lambda i, n, salt: F.concat(*[nine(f"{i}/{k}", min(9, n - k), salt) for k in range(0, n, 9)])
    hexed = lambda n, salt: F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)).cast("binary"), 256), 1, n)
    word = lambda salt, n=5: F.translate(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(salt)).cast("binary")), 1, n), "0123456789", "ghijklmnop")
    pick = lambda options, salt: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
    d = lambda fmt, salt: F.concat(*[F.lit(p) if not p.isdigit() else h(i, int(p), salt) for i, p in enumerate(fmt)])
    luhn = lambda base: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(base, c.cast("string"))), lambda x: _luhn(x)), 1)
    prose = ["the ", "of it, ", "and then ", "with ", "see ", "for a ", ""]
    calls, pays, keys, others = ["call ", "call me at ", "phone: ", "tel. ", "mobile ", "fax: ", "WhatsApp "], ["card ", "card number is ", "visa: ", "credit card no. ", "cc "], ['token = "', "api_key: ", "secret=", "password is ", "Authorization: Bearer ", 'access_key = "'], ["order ", "ISBN ", "invoice ", "version ", "commit ", "page ", "ref ", "id "]
    n, a, s = "number", "address", "secret"
    rows: list[tuple[str, Column, Column, int]] = []
    for k, fmt in enumerate((("(", "3", ") ", "3", "-", "4"), ("3", "-", "3", "-", "4"), ("3", ".", "3", ".", "4"), ("2", " ", "2", " ", "2", " ", "2", " ", "2"), ("4", " ", "6"), ("0", "4", "-", "7"), ("5", " ", "6"), ("10",))):
        f = tuple("0" if p == "0" else p for p in fmt) if fmt[0] != "0" else fmt[1:]
        rows += [(n, d(f, f"a{k}"), pick(calls, f"b{k}"), 1), (n, d(f, f"c{k}"), pick(others, f"d{k}"), 0)]
    for k, size in enumerate((14, 15, 16, 18)):
        rows += [(n, luhn(h(0, size - 1, f"e{k}")), pick([*pays, *prose], f"f{k}"), 1)]
        rows += [(n, h(0, size, f"g{k}"), pick([*others, *prose], f"h{k}"), 0)]
    rows += [(n, luhn(h(0, 12, "i")), pick(pays, "j"), 1), (n, h(0, 13, "k"), pick([*others, *prose], "l"), 0)]
    rows += [(n, F.concat(pick(["19", "20"], "m"), h(0, 2, "m"), F.lit("-0"), pick(list("123456789"), "m2"), F.lit("-1"), pick(list("0123456789"), "m3")), pick(prose, "m4"), 0)]
    for k, fmt in enumerate((("4", "-", "4"), ("7",), ("8",), ("12",), ("20",), ("1", ".", "3", ".", "3", ".", "3"), ("3", "-", "1", "-", "2", "-", "6", "-", "1"))):
        rows += [(n, d(fmt, f"n{k}"), pick([*others, *prose], f"o{k}"), 0)]
    rows += [(a, F.concat(word("p"), pick([" [at] ", "(at)", " (at) ", "[at]"], "p2"), word("q"), pick([" [dot] ", "(dot)", "."], "q2"), pick(["com", "org", "net"], "q3")), pick([*prose, "mail "], "r"), 1)]
    rows += [(a, F.concat(word("s"), F.lit(" (at) "), word("t", 3), F.lit(". "), word("u")), pick(prose, "v"), 0)]
    rows += [(s, hexed(40, "w"), pick(keys, "x"), 1), (s, hexed(32, "w2"), pick(keys, "x2"), 1), (s, F.base64(F.unhex(hexed(48, "y"))), pick(keys, "z"), 1)]
    rows += [(s, hexed(40, "A"), pick([*others, *prose], "B"), 0), (s, hexed(64, "C"), pick([*others, *prose], "D"), 0), (s, F.concat_ws("-", word("E"), word("F", 7), word("G", 8), h(0, 2, "H")), pick([*prose, *keys], "I"), 0)]
    rows += [(s, F.concat(word("J", 12), h(0, 1, "K"), word("L", 12)), pick(prose, "M"), 0), (s, F.concat_ws("/", word("N", 8), word("O", 8), h(0, 4, "P")), pick(prose, "Q"), 0)]
    options = F.array(*[F.struct(F.lit(KINDS.index(k)).alias("kind"), m.alias("match"), b.alias("before"), F.lit(y).alias("label")) for k, m, b, y in rows])
    return spark.range(0, ROWS, 1, 4).select("id", F.posexplode(options).alias("recipe", "x")).select("id", "recipe", "x.*")


def _tree(node, feature) -> Column:
    """A fitted tree as a Column; feature(i) is the value it looks at."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(feature(split.featureIndex()) <= float(split.threshold()), _tree(node.leftChild(), feature)).otherwise(_tree(node.rightChild(), feature))


class Booster:
    """The boosted trees and a threshold for each generator."""

    def __init__(self, spark: SparkSession):
        named = _recipes(spark).withColumn("f", _features(F.col("match"), F.col("before"), F.col("kind"))).select("id", "kind", F.col("label").cast("double").alias("label"), "f.*")
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(named)
        own = rows.filter("id % 4 <> 0").select("label", "features").coalesce(1)
        self.model: GBTClassificationModel = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, stepSize=0.3).fit(own)
        self.trees = [(float(w), t._java_obj.rootNode()) for w, t in zip(self.model.treeWeights, self.model.trees, strict=True)]
        apart = named.filter("id % 4 = 0").withColumn("p", self.probability(lambda i: F.col(FEATURES[i])))
        self.thresholds = {k: self._threshold([(r["p"], r["label"]) for r in apart.filter(F.col("kind") == KINDS.index(k)).select("p", "label").collect()]) for k in GENERATORS}

    @staticmethod
    def _threshold(scored: list[tuple[float, float]]) -> float:
        """The least score from which on the rows kept apart are positive with PRECISION; 0.5 at least."""
        best, right = 1.0, 0
        for n, (p, y) in enumerate(sorted(scored, reverse=True), 1):
            right += y == 1
            if right / n >= PRECISION:
                best = p
        return max(0.5, best)

    def probability(self, feature) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(w) * _tree(t, feature) for w, t in self.trees])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


_FITTED: dict[str, Booster] = {}


def booster(spark: SparkSession) -> Booster:
    """The booster of a Spark application, fitted once; the recipes are fixed, so any fit gives the same trees."""
    key = spark.sparkContext.applicationId
    if key not in _FITTED:
        _FITTED[key] = Booster(spark)
    return _FITTED[key]


def find_personal_data(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus n_email, n_ip, n_card, n_phone, n_added, base_spans and all_spans.

    base_spans are the matches of PATTERNS that pass their checks; each kind is matched on its own, leftmost first, and a match that
    fails is dropped. all_spans has besides, in KINDS order after these, what the boosted trees select from the generators'
    proposals and that overlaps no base span. Spans are structs (start, kind, end) with code points, end exclusive, kind by name,
    in order of start, then kind. Null and empty texts have none, rows alike fare alike, and an empty table stays empty. Columns of
    ``docs`` that bear the new names are replaced. Time is in proportion to a text's length and, but for sorting, its matches.
    """
    fitted = booster(docs.sparkSession)
    added = ["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_spans", "all_spans"]
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.drop(*[c for c in added if c in docs.columns and c != text])
    checked = lambda k: F.filter(_matches(whole, PATTERNS[k], HINTS[k], k), lambda x: _valid(k, x["match"]))
    base = [checked(k) for k in PATTERNS]
    proposed = [_matches(whole, p, HINTS[k], k) for k, p in GENERATORS.items()]
    plain = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    out = out.withColumns({"__base": F.array_sort(F.transform(F.concat(*base), plain)), "__new": F.concat(*proposed)})
    free = _with(F.col("__base"), lambda b: _with(F.col("__new"), lambda c: _free(b, c)))
    out = out.withColumn("__new", F.transform(free, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), _features(c["match"], c["before"], c["kind"]).alias("f"))))
    least = F.create_map(*[x for k, t in fitted.thresholds.items() for x in (F.lit(KINDS.index(k)), F.lit(t))])
    chosen = F.filter("__new", lambda c: fitted.probability(lambda i: c["f"][FEATURES[i]]) >= F.element_at(least, c["kind"]))
    out = out.withColumn("__all", F.array_sort(F.concat(F.col("__base"), F.transform(chosen, plain))))
    name = F.array(*[F.lit(k) for k in KINDS])
    named = lambda column: F.transform(column, lambda x: F.struct(x["start"].alias("start"), F.element_at(name, x["kind"] + 1).alias("kind"), x["end"].alias("end")))
    of_kind = lambda i: F.size(F.filter("__base", lambda x: x["kind"] == i)).cast("long")
    counts = {f"n_{k}": of_kind(i) for i, k in enumerate(PATTERNS)}
    out = out.withColumns(counts | {"n_added": (F.size("__all") - F.size("__base")).cast("long"), "base_spans": named("__base"), "all_spans": named("__all")})
    return out.drop("__base", "__new", "__all")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents in their own columns, each span of personal data replaced by its kind in angle brackets; overlapping spans are one, of the first one's kind.

    Null and empty texts stay as they are, rows alike fare alike, and an empty table stays empty. A text is cut into pieces once, and
    what stands between spans is taken from these.
    """
    found = find_personal_data(docs.withColumn("__text", F.col(text)), text="__text")

    def cut(pieces: Column, a: Column, z: Column) -> Column:
        """Code points from a to z, z exclusive."""
        first = F.floor(a / PIECE).cast("int")
        count = F.floor((z - 1) / PIECE).cast("int") - first + 1
        return F.when(z > a, F.substring(F.array_join(F.slice(pieces, first + 1, F.greatest(count, F.lit(1))), ""), a - first * PIECE + 1, z - a)).otherwise("")

    def replaced(pieces: Column, spans: Column, ends: Column) -> Column:
        each = F.zip_with(spans, ends, lambda x, e: F.when(x["start"] >= e, F.concat(cut(pieces, F.greatest(e, F.lit(0)), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(each, ""), cut(pieces, last, F.length("__text")))

    pieces = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{PIECE}}}"), 0)
    done = _with(pieces, lambda p: _with(F.col("all_spans"), lambda spans: _with(_highest_before(spans, lambda x: x["end"]), lambda ends: replaced(p, spans, ends))))
    clean = F.when(F.size("all_spans") > 0, done).otherwise(F.col("__text"))
    out = found.withColumn("__clean", clean)
    values = {text: F.col("__clean"), "n_chars": F.when(F.size("all_spans") > 0, F.length("__clean").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in docs.columns])
