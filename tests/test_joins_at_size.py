"""Joins of rows that explode makes: their sizes aren't known when Spark plans, so none of them may be sent whole through the driver."""

import pytest
from geolattice.operators import quadtree as Q
from geolattice.plans import QUERIES, iterative
from geolattice.session import saved

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["square_lattice", "overlay_shares", "overlay_difference", "hexagon_overlay", "value_by_sector"])
def test_no_exploded_side_is_broadcast(name, spark):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_corrected_access_makes_no_pairs(spark, tmp_path, monkeypatch):
    # all keys fall into one cell: 60 parks, some of them known, and 300 people
    step, kept = 10007 * 10009, []
    spark.createDataFrame([(k * step, k % 5, 9000.0) for k in range(60)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k * step,) for k in range(300)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(iterative, "saved", lambda df, name: kept.append(saved(df, name)) or kept[-1])
    got = QUERIES["corrected_access"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("high", 1.0, 1.0, 1.0), ("low", 1.0, 1.0, 1.0)]
    assert max(df.count() for df in kept) <= 5 * 2000 < 60 * 300


def test_lines_equal_to_nine_places_go_by_their_number(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    lines = spark.createDataFrame([(1, -5.0, 1.0 + 1e-12, 5.0, 1.0 + 1e-12), (2, -5.0, 1.0, 5.0, 1.0)], "line long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.line, round(r.d, 9)) for r in Q.nearest_line(points, lines, saved).collect()] == [(1, 1.0)]


def test_nearest_place_goes_by_leaves(spark):
    # by cells of 100, each place was in nine of them and each point met all places of its cell
    plan = QUERIES["nearest_place"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "leaf" in plan and "__i" in plan and "FLOOR((px" not in plan


def test_boxes_meet_leaves_by_key_alone(spark):
    # a condition beside the key would be asked for every leaf below each larger cell
    points = spark.range(300).selectExpr("id", "cast(id * 37 % 101 as double) as x", "cast(id * 53 % 97 as double) as y")
    tree = Q.build([points.select("x", "y")], saved, rows=4)
    met = Q.meeting(tree, points.selectExpr("id", "x - 3 as qx0", "x + 3 as qx1", "y - 3 as qy0", "y + 3 as qy1"))
    joins = [line for line in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    assert len(joins) == 2 and not any(" OR " in line for line in joins)
    boxes, leaves = points.collect(), tree.leaves.collect()
    want = {(p.id, q.leaf) for p in boxes for q in leaves if p.x - 3 <= q.hx and p.x + 3 >= q.lx and p.y - 3 <= q.hy and p.y + 3 >= q.ly}
    got = [(r.id, r.leaf) for r in met.collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    inner = {(p.id, q.leaf) for p in boxes for q in leaves if p.x - 3 < q.hx and p.x + 3 > q.lx and p.y - 3 < q.hy and p.y + 3 > q.ly}
    assert inner <= set(got)
