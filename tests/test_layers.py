"""Layers and tables read from files."""

import json

from geolattice.operators import polygons
from geolattice.session import saved
from geolattice.sources import layers
from pyspark.sql import functions as F


def test_kml(spark):
    ring = lambda *xy: "<Polygon><outerBoundaryIs><LinearRing><coordinates>" + " ".join(f"{x},{y},0" for x, y in xy) + "</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    square = ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    xml = f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Folder><Placemark><name>A</name>{square}</Placemark><Placemark><name>B</name><MultiGeometry>{square}{ring((5, 5), (6, 5), (6, 6))}</MultiGeometry></Placemark></Folder></Document></kml>'
    found = layers.kml_rings(spark.createDataFrame([("zones/2019/a.kml", xml), ("b.kml", xml.replace("A</name>", "C</name>"))], "path string, value string"))
    rows = sorted((r.path, r.name, r.year, r.ring, len(r.points)) for r in found.filter("path like 'zones%'").collect())
    assert rows == [("zones/2019/a.kml", "A", 2019, 0, 5), ("zones/2019/a.kml", "B", 2019, 0, 5), ("zones/2019/a.kml", "B", 2019, 1, 3)]
    assert {r.year for r in found.filter("path = 'b.kml'").collect()} == {None}
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.6, 5.5), (3, 9.0, 9.0)], "id int, x double, y double")
    inside = polygons.points_in_polygons(points, polygons.edges(found.filter("name = 'B' and path = 'b.kml'")))
    assert sorted(r.id for r in inside.collect()) == [1, 2]


def test_map_features(spark):
    ring = lambda a, b: [{"lat": y, "lon": x} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    elements = [
        {"type": "node", "id": 1, "lat": 3.0, "lon": 4.0, "tags": {"leisure": "pitch"}},
        {"type": "way", "id": 2, "tags": {"leisure": "park"}, "geometry": ring(0, 4)},
        {"type": "relation", "id": 3, "tags": {"natural": "water"}, "members": [{"role": "outer", "geometry": ring(0, 9)}, {"role": "inner", "geometry": ring(3, 6)}, {"role": "label", "geometry": ring(0, 1)}]},
        {"type": "way", "id": 4, "geometry": ring(0, 4)[:4]},
    ]
    found = layers.map_features(spark.createDataFrame([(json.dumps({"elements": elements}),)], "value string"))
    assert sorted((r.poly, r.ring, r.point is not None) for r in found.collect()) == [("node/1", None, True), ("relation/3", 0, False), ("relation/3", 1, False), ("way/2", 0, False)]
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 4.5, 4.5), (3, 7.0, 7.5)], "id int, x double, y double")
    inside = polygons.points_in_polygons(points, polygons.edges(found.filter("ring is not null")))
    assert sorted((r.id, r.poly) for r in inside.collect()) == [(1, "relation/3"), (1, "way/2"), (3, "relation/3")]


def test_census_and_pivot(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("﻿mun, pob \n20,7\n020,*\n21,5\n".encode())
    got = layers.census(spark, str(tmp_path / "c.csv"), "20").select("MUN", layers.number(F.col("POB")).alias("n"))
    assert sorted(map(tuple, got.collect())) == [("020", None), ("20", 7.0)]
    (tmp_path / "p.csv").write_text("sector,year,n\na,2001,3\na,2001,4\nb,2002,x\n")
    got = layers.pivoted(spark, str(tmp_path / "p.csv"), "sector", "year", "n", ["2001", "2002"])
    assert sorted(map(tuple, got.collect())) == [("a", 7.0, 0.0), ("b", 0.0, 0.0)]


def test_rings_of_open_ways(spark):
    way = lambda role, *xy: {"type": "way", "role": role, "geometry": [{"lat": float(y), "lon": float(x)} for x, y in xy]}
    elements = [
        # three outer ways in mixed directions, an inner ring of two, one that is closed, and a way that ends nowhere
        {"type": "relation", "id": 1, "tags": {"leisure": "park"}, "members": [
            way("outer", (0, 0), (10, 0), (10, 10)), way("outer", (0, 10), (5, 12), (10, 10)), way("", (0, 10), (0, 0)), way("outer", (10, 10), (20, 20), (30, 20)), way("outer", (30, 20), (31, 21)),
            way("inner", (2, 2), (4, 2), (4, 4)), way("inner", (2, 2), (2, 4), (4, 4)), way("inner", (6, 6), (6, 7), (7, 7), (7, 6), (6, 6)), {"type": "node", "role": "label"}, way("outer", (50, 50)),
        ]},
        # two rings that touch at a point, and two that share a side
        {"type": "relation", "id": 2, "members": [way("outer", (0, 0), (1, 0), (1, 1)), way("outer", (1, 1), (0, 1), (0, 0)), way("outer", (1, 1), (2, 1), (2, 2)), way("outer", (2, 2), (1, 2), (1, 1))]},
        {"type": "relation", "id": 3, "members": [way("outer", (0, 0), (0, 3)), way("outer", (0, 3), (-3, 3), (-3, 0), (0, 0)), way("outer", (0, 0), (3, 0), (3, 3), (0, 3))]},
        {"type": "relation", "id": 4, "members": [way("outer", (0, 0), (5, 5)), way("outer", (5, 5), (9, 0))]}, {"type": "relation", "id": 5}, {"type": "way", "id": 6},
    ]
    found = layers.relation_rings(spark.createDataFrame([(json.dumps({"elements": elements}),), ("{}",), (None,)], "value string"), saved).collect()
    area = lambda p: sum(a.x * b.y - b.x * a.y for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
    got = sorted((r.poly, r.hole, area(r.points), len(r.points)) for r in found)
    assert got == [
        ("relation/1", False, 110.0, 5), ("relation/1", True, 1.0, 4), ("relation/1", True, 4.0, 4), ("relation/2", False, 1.0, 4), ("relation/2", False, 1.0, 4), ("relation/3", False, 9.0, 4), ("relation/3", False, 9.0, 4),
    ]
    assert {r.poly: r.tags for r in found}["relation/1"] == {"leisure": "park"}
