"""GeoTIFF files: what is written is read, by windows that touch their own tiles only, in every layout that the source knows."""

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from geolattice.operators.grid import Grid
from geolattice.sources import geotiff
from pyspark.sql import functions as F

PLACE = {33550: (12, [2.0, 2.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 100.0, 900.0, 0.0]), 34735: (3, [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, 32613])}


def lzw(data: bytes) -> bytes:
    """Codes with high bits first, 256 at the start and wherever the table is full, one bit more as soon as an entry of that many is there."""
    table, bits, word = {bytes([i]): i for i in range(256)}, [], b""
    put = lambda code, width: bits.append(f"{code:0{width}b}")
    put(256, 9)
    free = 258
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], free.bit_length())
        table[longer], free, word = free, free + 1, data[i : i + 1]
        if free == 4094:
            put(256, 12)
            table, free = {bytes([i]): i for i in range(256)}, 258
    put(table[word], free.bit_length())
    put(257, (free + 1).bit_length())
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 50000: lambda d: pa.Codec("zstd").compress(d).to_pybytes()}


def tiff(values: np.ndarray, *, order="<", tile=None, compression=1, predictor=1, separate=False, tags=PLACE, reduced=None) -> bytes:
    """A classic file of (rows, columns, bands), in tiles of a side or in strips of some rows."""
    pages, out = [values] + ([reduced] if reduced is not None else []), bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8))
    for k, page in enumerate(pages):
        rows, columns, bands = page.shape
        high, wide = (tile, tile) if tile else (5, columns)
        blocks = []
        for plane in [page[:, :, [b]] for b in range(bands)] if separate else [page]:
            for r in range(0, rows, high):
                for c in range(0, columns, wide):
                    part = plane[r : r + high, c : c + wide]
                    if tile:
                        part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.diff(part.view(f"u{part.itemsize}"), axis=1, prepend=part.dtype.type(0).view(f"u{part.itemsize}"))
                        part = part.astype(part.dtype.newbyteorder(order))
                    elif predictor == 3:
                        n = part.shape[2]
                        weights = np.ascontiguousarray(part.astype(f">f{part.itemsize}")).reshape(part.shape[0], -1).view(np.uint8).reshape(part.shape[0], -1, part.itemsize).transpose(0, 2, 1).reshape(part.shape[0], -1, n)
                        part = np.diff(weights, axis=1, prepend=np.uint8(0))
                    else:
                        part = part.astype(part.dtype.newbyteorder(order))
                    blocks.append(PACK[compression](part.tobytes()))
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        fields = {254: (4, [k]), 256: (4, [columns]), 257: (4, [rows]), 258: (3, [page.itemsize * 8] * bands), 259: (3, [compression]), 277: (3, [bands]), 284: (3, [2 if separate else 1]), 317: (3, [predictor]), 339: (3, [kind] * bands)}
        fields |= {322: (3, [wide]), 323: (3, [high]), 324: (4, None), 325: (4, [len(b) for b in blocks])} if tile else {278: (4, [high]), 273: (4, None), 279: (4, [len(b) for b in blocks])}
        fields |= tags if k == 0 else {}
        start = len(out)
        more = start + 2 + 12 * len(fields) + 4
        size = lambda t, v: struct.calcsize("=" + {2: "s", 3: "H", 4: "I", 12: "d"}[t]) * (len(blocks) if v is None else len(v))
        data_at = more + sum(size(t, v) for t, v in fields.values() if size(t, v) > 4)
        offsets = [data_at + sum(map(len, blocks[:i])) for i in range(len(blocks))]
        body, rest = struct.pack(order + "H", len(fields)), b""
        for tag, (t, v) in sorted(fields.items()):
            v = offsets if v is None else v
            data = bytes(v) if t == 2 else struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[t] }", *v)
            body += struct.pack(order + "HHI", tag, t, len(v)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(order + "I", more + len(rest)))
            rest += data if len(data) > 4 else b""
        end = data_at + sum(map(len, blocks))
        out += body + struct.pack(order + "I", end if k + 1 < len(pages) else 0) + rest + b"".join(blocks)
    return bytes(out)


def grid_of(rows, shape):
    got = np.full(shape, np.nan)
    for x in rows:
        assert np.isnan(got[x.r, x.c, x.band - 1])
        got[x.r, x.c, x.band - 1] = np.nan if x.dn is None else x.dn
    return got


@pytest.mark.parametrize(("order", "tile", "compression", "predictor", "separate", "dtype"), [
    ("<", None, 1, 1, False, "u1"), (">", None, 5, 2, False, "u2"), ("<", 16, 5, 1, True, "i2"), (">", 16, 8, 2, True, "i4"), ("<", 16, 8, 3, False, "f4"), (">", None, 50000, 3, True, "f8"), ("<", 16, 50000, 1, False, "u4"),
])
def test_layouts(spark, tmp_path, order, tile, compression, predictor, separate, dtype):
    values = (np.random.default_rng(1).normal(60, 25, (37, 45, 2)).clip(1, 120)).astype(dtype)
    values[3, 4, 1] = 0
    (tmp_path / "a.tif").write_bytes(tiff(values, order=order, tile=tile, compression=compression, predictor=predictor, separate=separate))
    rows = geotiff.read(spark, str(tmp_path / "a.tif"), share=700).collect()
    want = values.astype(float)
    want[want == 0] = np.nan
    np.testing.assert_array_equal(grid_of(rows, values.shape), want)
    assert {(x.x - 2 * x.c, x.y + 2 * x.r, x.crs) for x in rows} == {(101.0, 899.0, "EPSG:32613")}


def test_long_tables_of_words():
    data = np.random.default_rng(2).integers(0, 256, 60000, dtype=np.uint8).tobytes() + b"ab" * 9000
    assert geotiff._lzw(lzw(data)) == data


def test_only_tiles_of_the_window(spark, tmp_path):
    values = np.arange(1, 64 * 64 + 1, dtype="u2").reshape(64, 64, 1)
    data = bytearray(tiff(values, tile=16, compression=8))
    image = geotiff.images(pa.PythonFile(pa.BufferReader(bytes(data)), mode="r"))[0]
    for k, (at, size) in enumerate(zip(image.offsets, image.sizes, strict=True)):
        if k not in (5, 6):  # every other tile can't be read
            data[at : at + size] = b"\xff" * size
    (tmp_path / "a.tif").write_bytes(data)
    source = geotiff.read(spark, "file://" + str(tmp_path))
    window = lambda *bounds: sorted((x.r, x.c, x.dn) for x in source.filter(" and ".join(bounds)).collect())
    want = [(r, c, float(values[r, c, 0])) for r in range(18, 30) for c in range(20, 44)]
    assert window("r >= 18", "r < 30", "c > 19", "c <= 43") == want
    assert window("y <= 863", "y > 839", "x > 140", "x < 188") == want
    assert window("r in (20, 21)", "c = 30") == [(r, 30, float(values[r, 30, 0])) for r in (20, 21)]
    assert window("r > 70") == window("r > 20", "r < 3") == window("band = 2") == []
    with pytest.raises(Exception, match="(?i)error"):
        window("r >= 18", "r < 40")


def test_reduced_images_nodata_and_points(spark, tmp_path):
    values = np.full((20, 20, 1), 7.0, "f4")
    values[0, :3, 0] = (np.nan, -9, 0)
    tags = {33550: (12, [1.0, 1.0, 0.0]), 33922: (12, [2.0, 3.0, 0.0, 12.0, 47.0, 0.0]), 34735: (3, [1, 1, 0, 3, 1025, 0, 1, 2, 3072, 0, 1, 32767, 3075, 0, 1, 24]), 42113: (2, b"-9\0")}
    (tmp_path / "a.TIF").write_bytes(tiff(values, tags=tags, reduced=np.full((10, 10, 1), 5.0, "f4")))
    (tmp_path / "notes.txt").write_text("no image")
    full = {(x.r, x.c): x for x in geotiff.read(spark, str(tmp_path)).collect()}
    assert len(full) == 400 and [full[0, c].dn for c in range(4)] == [None, None, 0.0, 7.0]
    assert (full[0, 0].x, full[0, 0].y, full[0, 0].crs) == (10.0, 50.0, "sinusoidal")
    small = geotiff.read(spark, str(tmp_path), resolution=3).collect()
    assert len(small) == 100 and {x.dn for x in small} == {5.0} and min(x.x for x in small) == 10.5
    assert geotiff.read(spark, str(tmp_path), nodata=7).filter("dn is null").count() == 398
    (tmp_path / "empty").mkdir()
    assert geotiff.read(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "b.tif").write_bytes(b"neither")
    with pytest.raises(Exception, match="not a TIFF"):
        geotiff.read(spark, str(tmp_path / "b.tif")).collect()


def test_written_files(spark, tmp_path):
    grid = Grid(-103.5, 20.25, -103.25, 20.75, 50, 100)
    cells = [(s, r, c, float(s + r * 50 + c), None if r == c else -1.5) for s in (1, 2) for r in range(100) for c in range(50) if not (s == 2 and r < 64)]
    cells += [(1, 3, 4, -70.0, 9.0), (1, 100, 0, 1.0, 1.0), (1, 0, -1, 1.0, 1.0), (None, 0, 0, 1.0, 1.0), (1, None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(cells, "file int, r int, c int, a double, tile double")
    done = geotiff.write(df, str(tmp_path / "out"), grid, ["a", "tile"], side=32, nodata=-9999)
    assert sorted((x.path.rpartition("/")[2], x.tiles) for x in done.collect()) == [("1.tif", 8), ("2.tif", 4)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.tif", "2.tif"]
    assert {x.path: x.bytes for x in done.collect()} == {str(p): p.stat().st_size for p in (tmp_path / "out").iterdir()}
    got = {(x.path.rpartition("/")[2], x.band, x.r, x.c): x.dn for x in geotiff.read(spark, str(tmp_path / "out")).filter("dn is not null").collect()}
    want = {(f"{s}.tif", b, r, c): v for s, r, c, a, t in cells[:-5] for b, v in ((1, a), (2, t)) if v is not None}
    assert got == want
    found = geotiff.describe(str(tmp_path / "out" / "1.tif"))
    assert (found.crs, found.nodata, found.tile) == ("EPSG:4326", -9999.0, (32, 32))
    assert math.isclose(found.grid().ymin, 20.25) and math.isclose(found.grid().xmax, -103.25)
    coarse = Grid(-103.5, 20.25, -103.0, 20.75, 20, 20)
    cells = geotiff.on_grid(spark, str(tmp_path / "out" / "1.tif"), coarse, scale=2.0, offset=1.0).filter("band = 1")
    assert sorted(map(tuple, cells.select("r", "c", "value").collect())) == [(r, c, 2.0 * (1 + (r * 5 + 2) * 50 + c * 5 + 2) + 1) for r in range(20) for c in range(10)]
    assert geotiff.write(df.filter("a is null"), str(tmp_path / "none"), grid, ["a"]).count() == 0


def test_projected_file_on_a_grid(spark, tmp_path):
    grid, source = Grid(-103.42, 20.6, -103.4, 20.62, 4, 4), Grid(664000.0, 2278000.0, 668000.0, 2282000.0, 40, 40)
    df = spark.range(1600).select(F.lit("u").alias("file"), F.floor(F.col("id") / 40).cast("int").alias("r"), (F.col("id") % 40).cast("int").alias("c"), (F.col("id") + 1.0).alias("v"))
    geotiff.write(df, str(tmp_path), source, ["v"], epsg=32613, side=16)
    from geolattice.operators.grid import utm

    got = {(x.r, x.c): x.value for x in geotiff.on_grid(spark, str(tmp_path / "u.tif"), grid).collect()}
    cells = spark.range(16).select(F.floor(F.col("id") / 4).alias("r"), (F.col("id") % 4).alias("c"))
    x, y = utm(*grid.centre(F.col("r"), F.col("c")), 13)
    want = {(p.r, p.c): math.floor((2282000 - p.y) / 100) * 40 + math.floor((p.x - 664000) / 100) + 1.0 for p in cells.select("r", "c", x.alias("x"), y.alias("y")).collect() if 664000 <= p.x < 668000 and 2278000 <= p.y < 2282000}
    assert got == want and len(want) > 8
