"""Queries on whole tables against plain versions."""

from bisect import bisect_right
from collections import Counter, defaultdict

from geolattice.plans import QUERIES
from geolattice.plans.fixtures import scenes
from geolattice.session import table

FOLDER = "/root/testdata/sf0.001"


def test_cohort_curves_of_every_customer(spark):
    months = defaultdict(Counter)
    for r in table(spark, FOLDER, "orders").selectExpr("o_custkey", "year(o_orderdate) * 12 + month(o_orderdate) as m").collect():
        months[r.o_custkey][r.m] += 1
    want = {(u, m - min(n)): round(min(sum(v for k, v in n.items() if k <= m) / 8, 1.0), 6) for u, n in months.items() for m in range(min(n), max(n) + 1)}
    got = QUERIES["cohort_curves"](spark, FOLDER).collect()
    assert len(got) == len(want) and {(r.unit, r.age): r.share for r in got} == want and len({u % 10 for u in months}) > 1


def test_as_of_all_scenes(spark):
    rows = scenes(spark, FOLDER).collect()
    best = defaultdict(dict)
    for r in rows:
        if r.cloud is not None:
            best[r.tile][r.day] = max(r.cloud, best[r.tile].get(r.day, r.cloud))
    days = {t: sorted(d) for t, d in best.items()}

    def latest(r):
        k = bisect_right(days[r.tile], r.day)
        return best[r.tile][days[r.tile][k - 1]] if k else None

    got = QUERIES["as_of"](spark, FOLDER).collect()
    assert sorted((r.scene_id, r.tile, r.day, r.cloud) for r in got) == sorted((r.scene_id, r.tile, r.day, latest(r)) for r in rows)


def test_measurement_union_of_whole_tables(spark):
    a, b = (table(spark, FOLDER, t).collect() for t in ("supplier", "customer"))
    want = [("a", r.s_suppkey, r.s_acctbal, None) for r in a] + [("b", r.c_custkey, None, r.c_name) for r in b]
    got = QUERIES["measurement_union"](spark, FOLDER).select("source", "id", "balance", "name").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(b) > 20
