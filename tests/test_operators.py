"""Edge cases of the operators, and plain versions of those that iterate or stream."""

import heapq
import json
import math
import random
from datetime import date, datetime

import pytest
from geolattice.functions import order_stats, radiometry
from geolattice.operators import dates, grid, kmeans, network, pixels, polygons, territory, zones
from geolattice.session import saved
from geolattice.sources import catalog, reports
from geolattice.streaming import monitor
from pyspark.sql import functions as F

BANDS = "scene int, r int, c int, red double, nir double, swir1 double, green double"


def test_mosaic_takes_a_scene_as_a_whole(spark):
    px = spark.createDataFrame([(2, 0, 0, 0.1, None, 0.1, 0.1), (1, 0, 0, 0.5, 0.6, 0.7, 0.8), (2, 0, 1, None, None, None, None)], BANDS)
    rows = pixels.first_valid(px, ["red", "nir"], -F.col("scene")).collect()
    assert [(r.r, r.c, r.src, r.red, r.nir) for r in rows] == [(0, 0, 1, 0.5, 0.6)]
    assert pixels.gap_fill(px, ["red", "nir"], -F.col("scene")).filter("c = 0").first()[2:] == (0.1, 0.6)


def test_index_is_null_where_the_sum_is_zero(spark):
    df = spark.createDataFrame([(0.5, -0.5), (0.0, 0.0), (None, 1.0), (0.6, 0.2)], "nir double, red double")
    assert [r[0] for r in df.select(radiometry.index("NDVI")).collect()] == [None, None, None, pytest.approx(0.5)]


def test_construction_bounds_are_inclusive_and_unknown_water_is_land(spark):
    # NDVI before 0.35 and after 0.30; green is null afterwards, so MNDWI is unknown
    px = spark.createDataFrame([(1, 0, 0, 13.0, 27.0, 0.1, 0.1), (2, 0, 0, 7.0, 13.0, 30.0, None), (1, 0, 1, 1.0, 9.0, 0.1, 0.1), (2, 0, 1, 7.0, 13.0, 30.0, 0.1)], BANDS)
    assert {(r.c, r.state) for r in pixels.construction(px, 1, 2).collect()} == {(0, "construction"), (1, "vegetation_loss")}
    assert {r.state for r in pixels.construction(px, 1, 2, green_before=None).collect()} == {"construction"}


def test_quality_bits(spark):
    df = spark.createDataFrame([(1,), (32,), (2,), (64,), (None,)], "b int")
    assert [r[0] for r in df.select(radiometry.quality_state(F.col("b"))).collect()] == [2, 1, 1, 0, 2]
    assert [r[0] for r in df.select(radiometry.quality_state(F.col("b"), (1, 2, 3, 4))).collect()] == [2, 0, 1, 0, 2]


def test_rank_percentiles(spark):
    values = [5.0, 1.0, 3.0, 2.0, 4.0, 3.0, None]
    got = order_stats.rank_percentiles(spark.createDataFrame([("k", v) for v in values], "k string, v double"), ["k"], "v", {f"p{int(s * 100)}": s for s in (0.0, 0.5, 0.98, 1.0)}).first()
    own = sorted(v for v in values if v is not None)
    assert list(got[1:]) == [own[min(len(own) - 1, int(s * len(own)))] for s in (0.0, 0.5, 0.98, 1.0)]


def test_zones_meet_at_corners(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (5, 5), (5, 6), (9, 9), (0, 0)], "r int, c int")
    found = lambda **k: sorted(r.cells for r in zones.zones(cells, saved, **k).collect())
    assert found() == [1, 2, 2] and found(neighbours=zones.FOUR) == [1, 1, 1, 2] and found(min_ha=2.0) == [2, 2] and found(min_ha=2.1) == []


def test_zones_against_flood_fill(spark):
    rng = random.Random(4)
    cells = {(rng.randrange(30), rng.randrange(30)) for _ in range(420)}
    sizes, left = [], set(cells)
    while left:
        stack, n = [left.pop()], 0
        while stack:
            r, c = stack.pop()
            n += 1
            for x in [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if x in left:
                    left.remove(x)
                    stack.append(x)
        sizes.append(n)
    got = [r.cells for r in zones.zones(spark.createDataFrame(sorted(cells), "r int, c int"), saved).collect()]
    assert sorted(got) == sorted(sizes)


def _components(cells, steps):
    left, out = set(cells), []
    while left:
        stack, own = [left.pop()], []
        while stack:
            r, c = stack.pop()
            own.append((r, c))
            for x in [(r + a, c + b) for a, b in steps]:
                if x in left:
                    left.remove(x)
                    stack.append(x)
        out.append(own)
    return out


def test_clean_mask_against_a_plain_version(spark):
    rng = random.Random(9)
    n = 24
    cells = {(r, c) for r in range(n) for c in range(n) if rng.random() < (0.75 if 4 <= r < 20 and 3 <= c < 18 else 0.12)}
    eight, four = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], [(0, 1), (1, 0), (0, -1), (-1, 0)]
    kept = {x for own in _components(cells, eight) if len(own) >= 3 for x in own}
    gaps = _components({(r, c) for r in range(n) for c in range(n)} - kept, four)
    kept |= {x for own in gaps if len(own) < 6 and all(0 < r < n - 1 and 0 < c < n - 1 for r, c in own) for x in own}
    weight = [math.exp(-(k * k) / 2) for k in range(-4, 5)]
    blurred = lambda r, c: sum(weight[a + 4] * weight[b + 4] for a in range(-4, 5) for b in range(-4, 5) if (r + a, c + b) in kept) / sum(weight) ** 2
    want = {(r, c) for r in range(n) for c in range(n) if blurred(r, c) >= 0.5}
    got = zones.clean_mask(spark.createDataFrame(sorted(cells), "r int, c int"), n, n, saved, least=3, hole=6)
    assert {(r.r, r.c) for r in got.collect()} == want and len(want) > 50


def test_outlines_and_fused_zones(spark):
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (5, 5, 2)], "r int, c int, zone int")
    sides = zones.outlines(cells).collect()
    assert sum(s.zone == 1 for s in sides) == 6 and sum(s.zone == 2 for s in sides) == 4
    named = spark.createDataFrame([(0, 0, "b"), (0, 3, "a"), (0, 9, "c")], "r int, c int, name string")
    assert {(r.name, r.fused) for r in zones.fused(named, "name", saved).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_grid_and_projections(spark):
    g = grid.Grid(-100.0, 20.0, -99.0, 21.0, 4, 2)
    point = spark.createDataFrame([(0, 0), (1, 3)], "r int, c int")
    assert [tuple(r) for r in point.select(*g.centre(F.col("r"), F.col("c"))).collect()] == [(-99.875, 20.75), (-99.125, 20.25)]
    place = spark.createDataFrame([(-99.9, 20.9), (-99.0, 20.5), (-99.01, 20.01)], "x double, y double").select(*g.place(F.col("x"), F.col("y")))
    assert [tuple(r) for r in place.collect()] == [(0, 0), (-1, -1), (1, 3)]
    # on the central meridian the easting is 500 km and the northing the scaled length of the meridian
    lat, steps = 20.0, 20_000
    e2, step = grid.FLATTENING * (2 - grid.FLATTENING), math.radians(20.0) / 20_000
    arc = sum(grid.AXIS * (1 - e2) / (1 - e2 * math.sin((k + 0.5) * step) ** 2) ** 1.5 * step for k in range(steps))
    east, north = spark.createDataFrame([(-99.0, lat)], "x double, y double").select(*grid.utm(F.col("x"), F.col("y"), 14)).first()
    assert east == pytest.approx(500000) and north == pytest.approx(0.9996 * arc, abs=0.01)
    west, east = (spark.range(1).select(*grid.utm(F.lit(-99.0 + d), F.lit(-20.0), 14, True)).first() for d in (-1.5, 1.5))
    assert west[0] + east[0] == pytest.approx(1e6) and west[1] == pytest.approx(east[1]) and east[0] > 650000 and east[1] < 1e7
    assert grid.Grid(-0.05, -0.05, 0.05, 0.05, 1, 1).hectares() == pytest.approx(11132 * 11057 / 10000, rel=1e-3)


def test_polygon_with_a_hole_and_outside(spark):
    rings = [("a", 0, [(1.2, 0.3), (7.1, 1.0), (6.4, 7.6), (0.6, 6.1)]), ("a", 1, [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0)]), ("far", 0, [(90.0, 90.0), (95.0, 90.0), (95.0, 95.0)])]
    edges = polygons.edges(spark.createDataFrame(rings, "poly string, ring int, points array<struct<x: double, y: double>>"))
    mask = polygons.scanline_mask(edges, 8, 8)
    assert mask.count() == 33 and mask.select("poly").distinct().count() == 1
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.0, 4.0), (3, 50.0, 1.0), (4, 91.0, 90.2)], "id int, x double, y double")
    assert {r.id: r.poly for r in polygons.first_containing(points, edges).collect()} == {1: "a", 2: None, 3: None, 4: "far"}


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [{"type": "Feature", "id": "s", "properties": {"k": "1"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}, {"type": "Feature", "properties": {}, "geometry": None}]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    found = catalog.polygons(spark, str(tmp_path / "a.json"))
    assert sorted((r.poly, r.ring, len(r.points)) for r in found.collect()) == [("feature-2", 0, 5), ("feature-2", 1, 5), ("s", 0, 5)]
    assert found.select(catalog.box(F.col("points"))).first()[0] == [0.0, 0.0, 2.0, 2.0]


def test_catalog(spark):
    band = {"href": "https://x/red.tif", "raster:bands": [{"scale": 0.0001, "offset": -0.1, "nodata": 0}]}
    item = lambda i, base, **k: json.dumps({"id": i, "bbox": [0, 0, 1, 1], "properties": {"datetime": "2025-01-02T00:49:00Z", "eo:cloud_cover": 5.0, "platform": "sentinel-2a", "grid:code": "MGRS-13RBN", "s2:processing_baseline": base} | k, "assets": {"red": band, "nir": {"href": "s3://x"}}})
    rows = spark.createDataFrame([(item("a", "05.09"),), (item("b", "05.11"),), (item("c", "05.00", **{"eo:cloud_cover": None}),)], "value string")
    found = catalog.scenes(rows)
    first = found.filter("id = 'a'").first()
    assert (first.day, first.platform, first.tile, first.assets["red"].scale, first.assets["nir"].scale) == (date(2025, 1, 1), "SENTINEL-2A", "13RBN", 0.0001, 1.0)
    assert catalog.newest_per_tile(found, ["red"]).first().id == "b" and catalog.newest_per_tile(found, ["red", "nir"]).isEmpty()
    assert catalog.search(found, (0.5, 0.5, 2, 2), "2025-01-01", "2025-01-01", 10).count() == 2
    assert catalog.search(found, (0.5, 0.5, 2, 2), "2025-01-01", "2025-01-01", 100).count() == 3 and catalog.search(found, (3, 3, 4, 4), "2025-01-01", "2025-01-01").isEmpty()


def test_dates(spark):
    days = spark.createDataFrame([(date(2024, m, d),) for m, d in ((1, 1), (1, 20), (3, 1), (3, 2), (5, 5))], "day date")
    assert [r[0] for r in dates.even_sample(days, 1).collect()] == [date(2024, 1, 1)] and dates.even_sample(days, 9).count() == 5 and dates.even_sample(days, 3).count() == 3
    assert dates.base_date(days, F.lit("2024-03-31").cast("date")).first() == (date(2024, 3, 1), 1)
    assert dates.base_date(days, F.lit("2024-02-29").cast("date"), within=3).first() == (date(2024, 1, 20), 2)
    assert [r.grade for r in dates.consecutive(days.withColumn("s", F.lit(1)), ["s"], "day").orderBy("first").collect()] == ["acceptable", "acceptable", "good", "doubtful"]


def test_network_against_dijkstra(spark):
    rng = random.Random(2)
    edges = [(a, b, rng.random()) for a in range(60) for b in rng.sample(range(60), 2) if a != b]
    near, best, heap = {}, {}, [(0.0, 3), (0.5, 41)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in near[x]:
                heapq.heappush(heap, (d + w, y))
    got = network.distances(spark.createDataFrame(edges, "src int, dst int, w double"), spark.createDataFrame([(3, 0.0), (41, 0.5)], "node int, d double"), saved)
    assert {r.node: r.d for r in got.collect()} == pytest.approx(best)


def test_kmeans(spark):
    rng = random.Random(1)
    rows = [(i, 10.0 * (i % 3) + rng.random(), 5.0 - 2 * (i % 3) + rng.random(), 7.0) for i in range(300)] + [(300, None, 1.0, 1.0)]
    labelled, summary = kmeans.kmeans(spark.createDataFrame(rows, "id long, a double, b double, flat double"), "id", ["a", "b", "flat"], 3)
    assert sorted(s["n"] for s in summary) == [100, 100, 100] and all(s["flat"] == pytest.approx(7) for s in summary)
    assert labelled.selectExpr("id % 3 as g", "label").distinct().count() == 3 and labelled.count() == 300
    with pytest.raises(ValueError, match="fewer valid rows"):
        kmeans.kmeans(spark.createDataFrame(rows[:2], "id long, a double, b double, flat double"), "id", ["a", "b"], 3)


def test_runoff_at_the_initial_abstraction(spark):
    s = 25400 / 80 - 254
    df = spark.createDataFrame([(0.2 * s, 80.0), (50.0, 100.0), (50.0, 80.0)], "p double, cn double")
    assert [r[0] for r in df.select(radiometry.runoff_depth(F.col("p"), F.col("cn"))).collect()] == [0.0, 50.0, pytest.approx((50 - 0.2 * s) ** 2 / (50 + 0.8 * s))]


def test_terciles_and_nearest(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 6, 7)] + [(None,)], "v double")
    assert [r.tercile for r in order_stats.terciles(df, "v").orderBy(F.col("v").asc_nulls_last()).collect()] == [1, 1, 1, 2, 2, 3, 3, None]
    near = territory.nearest(spark.createDataFrame([(1, 0.0, 0.0), (2, 99.0, 0.0)], "id int, x double, y double"), spark.createDataFrame([(7, 3.0, 4.0), (5, 3.0, -4.0)], "place int, px double, py double"), 10.0)
    assert near.collect() == [(1, 5, 5.0)]


def test_legend_csv_and_months(spark, tmp_path):
    reports.legend_csv(spark.createDataFrame([("r", 'a "b"', "1,5")], "result string, class string, detail string").coalesce(1), str(tmp_path / "l"))
    assert next((tmp_path / "l").glob("part*")).read_text() == '"result","class","detail"\n"r","a ""b""","1,5"\n'
    months = lambda *rows: spark.createDataFrame(list(rows), "month string, v int")
    for t in (months(("2024-01", 1), ("2024-02", 2)), months(("2024-02", 3))):
        reports.write_months(t, str(tmp_path / "m"))
    assert sorted((str(r.month), r.v) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [("2024-01", 1), ("2024-02", 3)]


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(datetime(2024, 1, d, 3), "a", float(d)) for d in range(1, 9)]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = monitor.daily(stream, late="1 day").writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("days").collect()) == sorted(monitor.daily(events).collect())


def test_months_are_merged_and_closed(spark, tmp_path):
    schema = "day date, n long"
    given, out, checkpoint = (str(tmp_path / x) for x in ("days", "out", "cp"))

    def batch(*rows):
        spark.createDataFrame([(date(2024, m, d), n) for m, d, n in rows], schema).coalesce(1).write.mode("append").parquet(given)
        monitor.keep_months(spark.readStream.schema(schema).parquet(given), out, checkpoint).awaitTermination(120)
        kept = monitor.kept_months(spark, out, spark.createDataFrame([], schema).schema).collect()
        return sorted(((r.month, r.day and r.day.day, r.n) for r in kept), key=str)

    assert batch((1, 5, 1)) == [("2024-01", 5, 1)]
    # January is still open and takes more; the next batch closes it, and February brings nothing
    assert batch((1, 20, 2)) == [("2024-01", 20, 2), ("2024-01", 5, 1)]
    closed = [("2024-01", 20, 2), ("2024-01", 5, 1), ("2024-02", None, None), ("2024-03", 3, 3)]
    assert batch((3, 3, 3)) == closed
    assert batch((1, 25, 9), (2, 1, 9)) == closed
    assert batch((3, 30, 4)) == sorted([*closed, ("2024-03", 30, 4)], key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
