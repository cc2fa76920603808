"""Draws against exact quantiles, and corrected coverage against a plain recount."""

import math
from collections import defaultdict

import pytest
from geolattice.functions import draws
from geolattice.operators import correction as C
from pyspark.sql import functions as F


def beta_quantiles(a, b, levels, n=200_000):
    """By summing the density over x = sin(t) ** 2, where it has no poles for a, b >= 0.5."""
    step = math.pi / 2 / n
    mass, total, cuts = [], 0.0, []
    for i in range(n):
        s, c = math.sin((i + 0.5) * step), math.cos((i + 0.5) * step)
        total += s ** (2 * a - 1) * c ** (2 * b - 1)
        mass.append(total)
    k = 0
    for level in levels:
        while mass[k] < level * total:
            k += 1
        cuts.append(math.sin((k + 0.5) * step) ** 2)
    return cuts


@pytest.mark.parametrize(("yes", "no"), [(0, 0), (0, 7), (3, 1), (40, 25)])
def test_draws_have_the_exact_quantiles(spark, yes, no):
    n, levels = 40_000, [0.05, 0.25, 0.5, 0.75, 0.95]
    shares = C.drawn_shares(spark.createDataFrame([("s", yes, no)], "stratum string, yes long, no long"), n, seed=3)
    below = [F.avg((F.col("share") <= q).cast("double")).alias(f"q{k}") for k, q in enumerate(beta_quantiles(yes + 0.5, no + 0.5, levels))]
    # four standard errors of a share of 40,000 draws
    got = shares.agg(*below, F.count("share").alias("n"), F.min("share").alias("low"), F.max("share").alias("high")).first()
    assert got.n == n and 0 <= got.low <= got.high <= 1 and list(got)[:5] == pytest.approx(levels, abs=0.0101)


def test_draws_depend_on_their_keys_alone(spark):
    rows = spark.range(2000).select("id", draws.normal(F.lit(1), F.col("id")).alias("x"), draws.uniform(F.lit(1), F.col("id")).alias("u"))
    again = {r.id: (r.x, r.u) for r in rows.repartition(7).collect()}
    assert {r.id: (r.x, r.u) for r in rows.coalesce(1).collect()} == again and len(set(again.values())) == 2000
    got = rows.agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.avg("u").alias("u"), F.corr("x", "u").alias("r")).first()
    assert abs(got.m) < 0.1 and abs(got.s - 1) < 0.07 and abs(got.u - 0.5) < 0.03 and abs(got.r) < 0.1


def test_corrected_coverage_against_a_recount(spark):
    n = 150
    things = [(i, "ab"[i % 2] if i % 7 else "c", {0: True, 1: False}.get(i % 9)) for i in range(40)]
    covers = [(i, b) for i in range(40) for b in range(60) if (i * 7 + b * 5) % 11 == 0] + [(0, 3), (0, 3)]
    people = [(b, b % 5) for b in range(61)]
    shares = C.drawn_shares(spark.createDataFrame([("a", 5, 2), ("b", 0, 3)], "stratum string, yes long, no long"), n)
    kept = C.kept_words(spark.createDataFrame(things, "thing long, stratum string, known boolean"), shares, n)
    got = {r.draw: r.share for r in C.covered(kept, spark.createDataFrame(covers, "thing long, block long"), spark.createDataFrame(people, "block long, pop long"), n).collect()}
    p = {(r.draw, r.stratum): r.share for r in shares.collect()}
    u = {(r.d, r.t): r.u for r in spark.range(n).select(F.col("id").cast("int").alias("d")).crossJoin(spark.range(40).withColumnRenamed("id", "t")).select("d", "t", draws.uniform(F.lit(0), F.lit("keep"), F.col("d"), F.col("t")).alias("u")).collect()}
    of = defaultdict(set)
    for t, b in covers:
        of[t].add(b)
    for d in range(n):
        # stratum c wasn't reviewed, so of its things only those known to be right count
        on = {b for t, s, known in things if (known if known is not None else s != "c" and u[d, t] < p[d, s]) for b in of[t]}
        assert got[d] == pytest.approx(sum(w for b, w in people if b in on) / sum(w for _, w in people))
