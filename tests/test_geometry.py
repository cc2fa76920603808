"""Overlays, rings, runs, the adaptive partition and networks against plain versions that work otherwise."""

import heapq
import math
import random
from collections import Counter, defaultdict

import pytest
from geolattice.operators import network as N
from geolattice.operators import overlay as O
from geolattice.operators import quadtree as Q
from geolattice.operators import rings as L
from geolattice.operators import shapes as H
from geolattice.operators import spans as S
from geolattice.operators.zones import outlines
from geolattice.session import saved
from pyspark.sql import functions as F

RINGS = "poly long, ring int, points array<struct<x: double, y: double>>"


def star(rng, x, y, size, n=None):
    n = n or rng.randint(3, 9)
    return [(x + size * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]


def shapes(seed, n, extent=40, size=9):
    """{poly: rings}; some have a hole, rings run either way."""
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        x, y = rng.uniform(0, extent), rng.uniform(0, extent)
        out[k] = [star(rng, x, y, size)] + ([star(rng, x, y, size * 0.2)] if k % 3 == 0 else [])
        out[k] = [r[::-1] if rng.random() < 0.5 else r for r in out[k]]
    return out


def edges_of(spark, polygons):
    return O.oriented(spark.createDataFrame([(k, i, [(float(x), float(y)) for x, y in r]) for k, rs in polygons.items() for i, r in enumerate(rs)], RINGS))


def sides(rings):
    return [(*a, *b) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)]


def plain_area(polygons, keep):
    """The area where keep(set of the polygons there) holds, by vertical stretches between all corners and crossings."""
    every = [(k, s) for k, rs in polygons.items() for s in sides(rs)]
    xs = {v for _, s in every for v in (s[0], s[2])}
    for i, (_, (a, b, c, d)) in enumerate(every):
        for _, (e, f, g, h) in every[:i]:
            cross = (c - a) * (h - f) - (d - b) * (g - e)
            if cross:
                t, u = ((e - a) * (h - f) - (f - b) * (g - e)) / cross, ((e - a) * (d - b) - (f - b) * (c - a)) / cross
                if 0 <= t <= 1 and 0 <= u <= 1:
                    xs.add(a + t * (c - a))
    xs, total = sorted(xs), 0.0
    for l, r in zip(xs, xs[1:], strict=False):
        m = (l + r) / 2
        cuts = sorted((b + (m - a) / (c - a) * (d - b), k) for k, (a, b, c, d) in every if (a > m) != (c > m))
        there = set()
        for (y, k), (y2, _) in zip(cuts, cuts[1:], strict=False):
            there ^= {k}
            total += (r - l) * (y2 - y) * keep(there)
    return total


@pytest.mark.parametrize("cell", [3.0, 50.0])
def test_common_areas_of_polygons_with_holes(spark, cell):
    a, b = shapes(1, 9), shapes(2, 8, size=14)
    got = {(r.a, r.b): r.area for r in O.intersection_areas(edges_of(spark, a), edges_of(spark, b), cell).collect()}
    for i, x in a.items():
        for j, y in b.items():
            assert got.get((i, j), 0.0) == pytest.approx(plain_area({0: x, 1: y}, lambda s: len(s) == 2), abs=1e-6)


def test_shares_add_up_and_the_rest_is_outside(spark):
    a, b = {0: [[(0, 0), (4, 0), (4, 4), (0, 4)]], 1: [[(20, 20), (21, 20), (21, 21)]]}, {5: [[(2, 2), (9, 2), (9, 9), (2, 9)]], 6: [[(-3, 0), (1, 0), (1, 1), (-3, 1)]]}
    e = edges_of(spark, a)
    got = {(r.a, r.b): (r.area, r.share) for r in O.shares(e, O.intersection_areas(e, edges_of(spark, b), 5.0), -1).collect()}
    assert got == {(0, 5): (4.0, 0.25), (0, 6): (1.0, 0.0625), (0, -1): (11.0, 0.6875), (1, -1): (0.5, 1.0)}


def test_overlay_of_nothing_and_of_broken_rings(spark):
    none, some = O.oriented(spark.createDataFrame([(1, 0, None), (2, 0, []), (3, 0, [(0.0, 0.0), (1.0, 1.0)])], RINGS)), edges_of(spark, shapes(1, 2))
    assert none.count() == 0 and O.intersection_areas(none, some, 5.0).count() == 0 and O.dissolve(none, F.lit(0), 5.0, saved).count() == 0


@pytest.mark.parametrize("cell", [2.0, 30.0])
def test_dissolved_area_counts_overlaps_once(spark, cell):
    # squares that share a side, one inside another, equal ones, and stars
    special = {100: [[(0, 0), (3, 0), (3, 3), (0, 3)]], 101: [[(3, 0), (6, 0), (6, 3), (3, 3)]], 102: [[(1, 1), (2, 1), (2, 2), (1, 2)]], 103: [[(0, 0), (3, 0), (3, 3), (0, 3)]], 104: [[(2, 3), (5, 3), (5, 5), (2, 5)]]}
    polygons = {0: special, 1: shapes(3, 12, extent=25), 2: shapes(4, 7, extent=60)}
    edges = None
    for g, p in polygons.items():
        e = edges_of(spark, p).withColumn("poly", F.col("poly") + 1000 * g)
        edges = e if edges is None else edges.unionByName(e)
    got = {r.g: r.area for r in O.areas(O.dissolve(edges, F.floor(F.col("poly") / 1000), cell, saved), "g").collect()}
    want = {g: plain_area(p, bool) for g, p in polygons.items()}
    assert got == pytest.approx(want) and want[0] == pytest.approx(24)


# rings


def parts(cells, eight):
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    left, out = set(cells), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            for a, b in near:
                if (r + a, c + b) in left:
                    left.remove((r + a, c + b))
                    todo.append((r + a, c + b))
        out.append(part)
    return out


@pytest.mark.parametrize("join", [True, False])
def test_rings_of_cells(spark, join):
    rng = random.Random(7)
    zones = {1: {(r, c) for r in range(14) for c in range(14) if rng.random() < 0.6}, 2: {(r, c) for r in range(30, 40) for c in range(10) if not (3 <= r - 30 <= 6 and 3 <= c <= 6)}, 3: {(50, 50)}, 4: {(60, 60), (61, 61)}}
    zones[5] = {(70, c) for c in range(300)}
    cells = spark.createDataFrame([(r, c, z) for z, s in zones.items() for r, c in s], "r long, c long, zone long")
    corners = L.traced(outlines(cells), saved, corners_join=join)
    got = defaultdict(list)
    for r in corners.collect():
        got[r.zone, r.ring, r.hole].append((r.pos, r.x, r.y))
    found = {(r.zone, r.ring): r for r in L.ring_areas(corners).collect()}
    areas = defaultdict(lambda: ([], []))
    for (zone, ring, hole), points in got.items():
        points = [p[1:] for p in sorted(points)]
        # all turns are right angles, and rings close
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(points, points[1:] + points[:1], strict=True)) and len(points) % 2 == 0
        twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
        assert (twice < 0) == hole and found[zone, ring].area == twice / 2 and found[zone, ring].corners == len(points)
        areas[zone][hole].append(abs(twice) / 2)
    for z, s in zones.items():
        own = parts(s, join)
        holes = [h for h in parts({(r, c) for r in range(-1, 80) for c in range(-1, 302)} - s, not join) if (-1, -1) not in h]
        assert len(areas[z][0]) == len(own) and sorted(areas[z][1]) == sorted(map(len, holes))
        assert sum(areas[z][0]) - sum(areas[z][1]) == len(s)
    assert L.features(corners.filter("zone = 3")).first().json in {f"[[{x},{y}],{rest}" for x, y, rest in [(50, 50, "[51,50],[51,51],[50,51],[50,50]]"), (51, 50, "[51,51],[50,51],[50,50],[51,50]]"), (51, 51, "[50,51],[50,50],[51,50],[51,51]]"), (50, 51, "[50,50],[51,50],[51,51],[50,51]]")]}


def test_ranks_of_a_permutation(spark):
    rng = random.Random(2)
    order = list(range(500))
    rng.shuffle(order)
    rings, k = [], 0
    for n in (1, 1, 2, 3, 17, 64, 65, 100, 247):
        rings.append(order[k : k + n])
        k += n
    next_ = [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))]
    got = {r.side: (r.ring, r.pos) for r in L.ranked(spark.createDataFrame(next_, "side long, next long"), saved).collect()}
    want = {}
    for r in rings:
        first = r.index(min(r))
        want |= {s: (min(r), (i - first) % len(r)) for i, s in enumerate(r)}
    assert got == want


# runs


def opened(spans, *keys):
    return Counter((*[r[k] for k in keys], r["r"], c) for r in spans.collect() for c in range(r["c0"], r["c1"] + 1))


def some_spans(spark, seed, n=80):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 2), rng.randint(0, 5), a := rng.randint(-20, 60), a + rng.randint(0, 15)) for _ in range(n)]
    return spark.createDataFrame(rows, "k int, r long, c0 long, c1 long")


def test_runs_as_sets(spark):
    a, b, c = (some_spans(spark, s) for s in (1, 2, 3))
    x, y, z = (set(opened(s)) for s in (a, b, c))
    for keep, want in ((F.col("a") & F.col("b"), x & y), (F.col("a") | F.col("b"), x | y), (F.col("a") & ~F.col("b"), x - y), ((F.col("a") | F.col("b")) & ~F.col("c"), (x | y) - z)):
        got = opened(S.combine({"a": a, "b": b, "c": c}, keep))
        assert set(got) == want and all(n == 1 for n in got.values())
    keyed = opened(S.union(a, "k"), "k")
    assert set(keyed) == set(opened(a, "k")) and set(keyed.values()) == {1}
    assert S.measured({"a": a, "b": b}, {"both": F.col("a") & F.col("b"), "none": F.lit(False)}).first().asDict() == {"both": len(x & y), "none": 0}
    assert S.combine({"a": a.limit(0), "b": b}, F.col("a") & F.col("b")).count() == 0
    assert sum(1 for _ in S.union(a).collect()) == sum(1 for r, q in x if (r, q - 1) not in x)


def test_exclusive_runs_and_what_they_share(spark):
    a, mask = some_spans(spark, 4).withColumnRenamed("k", "h"), S.union(some_spans(spark, 5))
    first = {}
    for h, r, c in opened(a, "h"):
        first[r, c] = min(h, first.get((r, c), h))
    ex = S.exclusive(a, "h", [0, 1, 2])
    assert opened(ex, "h") == Counter((h, *p) for p, h in first.items())
    assert opened(S.shared(ex, mask, "h"), "h") == Counter((first[p], *p) for p in opened(mask) if p in first)
    cells = spark.createDataFrame([(r, c, r * 100 + c) for r in range(-1, 8) for c in range(-25, 80)], "r long, c long, v long")
    got = {(r.r, r.c): (r.h, r.v) for r in S.located(cells, ex, "h").collect()}
    assert got == {(r, c): (first.get((r, c)), r * 100 + c) for r in range(-1, 8) for c in range(-25, 80)}
    assert {r.h: r.cells for r in S.cells_of(ex, "h").collect()} == Counter(first.values())


def test_runs_of_cells_and_polygons(spark):
    rng = random.Random(9)
    cells = [(k, rng.randint(0, 4), rng.randint(0, 30)) for k in (1, 2) for _ in range(120)]
    runs = S.of_cells(spark.createDataFrame(cells, "k int, r int, c int"), "k")
    assert opened(runs, "k") == Counter(set(cells))
    polygons = shapes(11, 6)
    got = opened(S.of_polygons(edges_of(spark, polygons)), "poly")
    inside = lambda rs, x, y: sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in sides(rs)) % 2
    assert set(got) == {(k, r, c) for k, rs in polygons.items() for r in range(-20, 70) for c in range(-20, 70) if inside(rs, c + 0.5, r + 0.5)}
    coarse = S.scaled(runs.drop("k"), 3)
    assert set(opened(coarse)) == {(3 * r + a, 3 * c + b) for _, r, c in cells for a in range(3) for b in range(3)}


# the adaptive partition


def points(seed, n=900):
    """A third of all points within a thousandth of the plane."""
    rng = random.Random(seed)
    rows = [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) if i % 3 else (i, 500 + rng.random(), 500 + rng.random() * 0.1) for i in range(n)]
    return [*rows, (9000, -5000.0, 3.0), (9001, None, 1.0), (9002, 500.0, 500.0)]


def test_nearest_place_however_far(spark):
    rng = random.Random(3)
    places = [(i, rng.gauss(500, 3), rng.gauss(500, 3)) for i in range(300)] + [(i, rng.uniform(0, 1000), rng.uniform(0, 1000)) for i in range(300, 330)] + [(500, 500.0, 500.0), (499, 500.0, 500.0), (777, None, 2.0)]
    own = points(1)
    frame = spark.createDataFrame(own, "id long, x double, y double")
    got = {r.id: r.place for r in Q.nearest_place(frame, spark.createDataFrame(places, "place long, px double, py double"), saved, 20).collect()}
    assert got == {i: min((math.hypot(x - a, y - b), p) for p, a, b in places if a is not None)[1] for i, x, y in own if x is not None}
    assert Q.nearest_place(frame, spark.createDataFrame([], "place long, px double, py double"), saved).count() == 0


def away(x, y, x0, y0, x1, y1):
    n = (x1 - x0) ** 2 + (y1 - y0) ** 2
    t = min(max(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n, 0), 1) if n else 0
    return math.hypot(x - (x0 + t * (x1 - x0)), y - (y0 + t * (y1 - y0)))


def test_nearest_line_however_far(spark):
    rng = random.Random(4)
    lines = [(i, *(a := (rng.uniform(0, 1000), rng.uniform(0, 1000))), a[0] + rng.gauss(0, 30), a[1] + rng.gauss(0, 30)) for i in range(150)] + [(300, 0.0, 0.0, 1000.0, 900.0), (301, 5.0, 5.0, 5.0, 5.0), (302, None, 1.0, 1.0, 1.0)]
    own = points(2)
    got = {r.id: r.d for r in Q.nearest_line(spark.createDataFrame(own, "id long, x double, y double"), spark.createDataFrame(lines, "line long, x0 double, y0 double, x1 double, y1 double"), saved, 20).collect()}
    assert got == pytest.approx({i: min(away(x, y, *s[1:]) for s in lines if s[1] is not None) for i, x, y in own if x is not None})


def test_points_in_polygons_by_leaf(spark):
    polygons = shapes(8, 40, extent=1000, size=60) | {100: [star(random.Random(1), 500, 500, 3)], 101: [star(random.Random(2), 500, 500, 700, 40)]}
    own = [p for p in points(3) if p[1] is not None]
    edges = edges_of(spark, polygons)
    got = {(r.id, r.poly) for r in Q.containing(spark.createDataFrame(own, "id long, x double, y double"), edges, saved, 20).collect()}
    inside = lambda rs, x, y: sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for a, b, c, d in sides(rs)) % 2
    assert got == {(i, k) for i, x, y in own for k, rs in polygons.items() if inside(rs, x, y)}


def test_leaves_part_the_plane_and_stay_even(spark):
    own = [p for p in points(5, 6000) if p[1] is not None and p[1] >= 0]
    frame = spark.createDataFrame(own, "id long, x double, y double")
    tree = Q.build([frame.select("x", "y")], saved, 64)
    counts = Counter(r.leaf for r in Q.located(tree, frame).collect())
    leaves = tree.leaves.collect()
    assert sum(counts.values()) == len(own) and max(counts.values()) <= 64
    assert sum((r.hx - r.lx) * (r.hy - r.ly) for r in leaves) == pytest.approx(tree.size**2)
    boxes = [(i, x, y, x + w, y + w / 2) for i, (x, y, w) in enumerate((x, y, w) for _, x, y in own[:40] for w in (0.01, 3.0, 400.0))]
    met = {(r.i, r.leaf) for r in Q.meeting(tree, spark.createDataFrame(boxes, "i long, qx0 double, qy0 double, qx1 double, qy1 double")).collect()}
    assert met == {(i, r.leaf) for i, a, b, c, d in boxes for r in leaves if a <= r.hx and c >= r.lx and b <= r.hy and d >= r.ly}


# networks


def dijkstra(near, start):
    best, heap = {}, [(d, n) for n, d in start.items()]
    heapq.heapify(heap)
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in near[x]:
                heapq.heappush(heap, (d + w, y))
    return best


def test_matrix_against_dijkstra(spark):
    rng = random.Random(6)
    nodes = [(i, rng.uniform(0, 1500), rng.uniform(0, 1500)) for i in range(220)]
    edges = [(a, b, rng.uniform(5, 90)) for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(420)) if a != b]  # the last twenty nodes are apart
    edges += [(7, 8, 10.0), (8, 7, 4.0)]
    near = defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    squares = {p: (rng.uniform(0, 1500), rng.uniform(0, 1500), rng.choice([4, 40, 120])) for p in range(25)} | {50: (9000.0, 9000.0, 5.0)}
    box = {p: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)] for p, (x, y, h) in squares.items()}
    origins = [(i, rng.uniform(0, 1500), rng.uniform(0, 1500)) for i in range(60)] + [(100, squares[0][0], squares[0][1])]
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    places = frame([(p, *map(float, s)) for p, r in box.items() for s in sides([r])], "place long, x0 double, y0 double, x1 double, y1 double")
    spots = frame(nodes, "node long, x double, y double")
    want = {}
    for p, (px, py, h) in squares.items():
        d = {n: 0.0 if abs(x - px) < h and abs(y - py) < h else min(away(x, y, *s) for s in sides([box[p]])) for n, x, y in nodes}
        ok = {n: v for n, v in d.items() if v <= 20} or {n: v for v, n in [min((v, n) for n, v in d.items())] if v <= 150}
        want[p] = ok
    got = defaultdict(dict)
    for r in N.entries(spots, places).collect():
        got[r.place][r.node] = r.d
    assert {p: got[p] for p in squares} == {p: pytest.approx(v) for p, v in want.items()} and not want[50]
    reach = {p: dijkstra(near, v) for p, v in want.items()}
    plain = {}
    for i, x, y in origins:
        on, node = min((math.hypot(x - a, y - b), n) for n, a, b in nodes)
        for p, (px, py, h) in squares.items():
            if abs(x - px) < h and abs(y - py) < h:
                plain[i, p] = 0.0
            elif node in reach[p]:
                plain[i, p] = on + reach[p][node]
    found = N.matrix(frame(edges, "src long, dst long, w double"), spots, places, frame(origins, "id long, x double, y double"), saved)
    assert {(r.id, r.place): r.d for r in found.collect()} == pytest.approx(plain)


def test_distances_with_a_limit_and_without_sources(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)] + [(0, 40, 100.0)], "src long, dst long, w double")
    source = spark.createDataFrame([(0, 0.0), (0, 3.0)], "node long, d double")
    assert {r.node: r.d for r in N.distances(edges, source, saved).collect()} == {i: float(i) for i in range(41)}
    assert {r.node for r in N.distances(edges, source, saved, 9.0).collect()} == set(range(10))
    assert N.distances(edges, source.limit(0), saved).count() == 0


# shapes and closing


def test_shape_features(spark):
    rng = random.Random(12)
    polygons = {k: [star(rng, 0, 0, 10)] for k in range(60)} | {100: [[(0, 0), (5, 0), (5, 0), (2, 0)]], 101: [[(1, 1)]], 102: [[(0, 0), (30, 0), (30, 2), (0, 2)]]}
    rows = [(k, i, [(float(x), float(y)) for x, y in r]) for k, rs in polygons.items() for i, r in enumerate(rs)]
    got = {r.poly: r for r in H.shape_features(spark.createDataFrame([*rows, (200, 0, []), (201, 0, None)], RINGS)).collect()}
    assert set(got) == set(polygons)
    for k, (ring,) in polygons.items():
        best = (math.inf, 0, 0)
        for a in ring:
            for b in ring:
                n = math.dist(a, b)
                if n:
                    u, v = ((b[0] - a[0]) / n, (b[1] - a[1]) / n), (-(b[1] - a[1]) / n, (b[0] - a[0]) / n)
                    x, y = ([p[0] * w[0] + p[1] * w[1] for p in ring] for w in (u, v))
                    w, h = max(x) - min(x), max(y) - min(y)
                    best = min(best, (round(w * h, 6), min(w, h), max(w, h))) if min(p[0] * v[0] + p[1] * v[1] for p in ring) > a[0] * v[0] + a[1] * v[1] - 1e-9 else best
        if k < 100:
            assert (got[k].width * got[k].length, got[k].elongation) == pytest.approx((best[0], best[2] / max(best[1], 1)), rel=1e-6)
    assert (got[100].width, got[100].length, got[101].length, got[101].compactness) == (0, 5, 0, 0)
    assert (got[102].width, got[102].length, got[102].elongation, got[102].area, got[102].outline) == (2, 30, 15, 60, 64)


@pytest.mark.parametrize("reach", [1, 3])
def test_closing_of_runs(spark, reach):
    rng = random.Random(13)
    cells = {(rng.randint(0, 25), rng.randint(0, 40)) for _ in range(140)}
    disc = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= reach * reach]
    wide = {(r + a, c + b) for r, c in cells for a, b in disc}
    runs = S.of_cells(spark.createDataFrame(sorted(cells), "r int, c int"))
    assert set(opened(S.grown(runs, reach))) == wide
    shut = {p for p in wide if all((p[0] + a, p[1] + b) in wide for a, b in disc)}
    done = S.closed(runs, reach)
    assert set(opened(done)) == shut and cells <= shut
    found = defaultdict(set)
    for r in S.zoned(done, saved, bucket=4).collect():
        found[r.zone] |= {(r.r, c) for c in range(r.c0, r.c1 + 1)}
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, parts(shut, False)))


def test_fused_parts_take_the_name_of_the_largest(spark):
    rows = [*[("b", r, 0, 3) for r in range(9)], *[("a", r, 6, 7) for r in range(9)], ("a", 0, 6, 7), ("c", 19, 0, 1), ("d", 19, 1, 2)]
    of, zones = S.fused(spark.createDataFrame(rows, "part string, r long, c0 long, c1 long"), "part", 2, saved)
    name = {r.zone: (r.name, r.parts) for r in zones.collect()}
    assert {r.part: (name[r.zone], r.cells) for r in of.collect()} == {"a": (("b", 2), 18), "b": (("b", 2), 36), "c": (("c", 2), 2), "d": (("c", 2), 2)}
