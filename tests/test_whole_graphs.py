"""Graph queries against plain versions."""

import heapq
from collections import defaultdict

import pytest
from geolattice.plans import QUERIES
from geolattice.plans.iterative import street_grid
from geolattice.session import table

FOLDER = "/root/testdata/sf0.001"


def test_components_of_all_rows(spark, tmp_path):
    # part 1 joins orders 1 and 2; order 3 and part 3 have equal keys
    rows = [(1, 1, 4, 50), (2, 1, 2, 40), (2, 7, 1, 30), (3, 3, 3, 20), (6010, 9, 7, 13), (3008, 9, 7, 13)]
    rows += [(o, 100 + o * o % 37, 1 + o % 7, 13) for o in range(4000, 4200)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity int").write.parquet(str(tmp_path / "lineitem.parquet"))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for o, p, *_ in rows:
        a, b = sorted((root(2 * o), root(2 * p + 1)))
        up[b] = a
    got = QUERIES["components"](spark, str(tmp_path)).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, root(x)) for x in up)


def test_network_distance_from_every_supplier(spark):
    keys = [r[0] for r in table(spark, FOLDER, "supplier").select("s_suppkey").collect()]
    grid = street_grid(spark, 24).collect()
    near, best, heap = defaultdict(list), {}, [(0.0, 4 * k) for k in keys]
    for r in grid:
        near[r.src].append((r.dst, r.w))
        near[r.dst].append((r.src, r.w))
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in near[x]:
                heapq.heappush(heap, (d + w, y))
    got = {r.node: r.d for r in QUERIES["network_distance"](spark, FOLDER).collect()}
    assert got == pytest.approx(best) and sum(d == 0 for d in got.values()) == len(set(keys))
