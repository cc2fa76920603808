"""GeoTIFF files as a data source that reads windows only, and as a sink.

``spark.read.format("geotiff")`` gives one row for each pixel and band. Bounds on r, c, x, y and band go into the source: a task reads a
file's directory and the tiles (or strips) of its share that the bounds touch. The driver lists files and opens none.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from geolattice.operators.grid import AXIS, Grid, sinusoidal, utm
from geolattice.session import saved

SCHEMA = "path string, crs string, band int, r int, c int, x double, y double, dn double"
#: Bytes of a file for each task.
SHARE = 32 << 20
#: Fixed values of the format: struct codes of field types, kinds of samples, and the tags and geo keys used here.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SAMPLES = {1: "u", 2: "i", 3: "f"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, BANDS, ROWS_OF_STRIP, STRIP_SIZES, PLANAR = 254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, EXTRA, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, NODATA = 33550, 33922, 34264, 34735, 34736, 42113
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED, PROJECTION = 1024, 1025, 2048, 3072, 3075
NONE, LZW, DEFLATE, OLD_DEFLATE, ZSTD, OWN_CODE, SINUSOIDAL = 1, 5, 8, 32946, 50000, 32767, 24


@dataclass(frozen=True)
class Image:
    """One image of a file: its size, how its tiles lie, and where it is. (x0, y0) is the upper left corner; crs is EPSG:n, sinusoidal or null."""

    width: int
    height: int
    bands: int
    tile: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    separate: bool
    dtype: str
    x0: float
    y0: float
    dx: float
    dy: float
    crs: str | None
    nodata: float | None

    def grid(self) -> Grid:
        return Grid(self.x0, self.y0 - self.height * self.dy, self.x0 + self.width * self.dx, self.y0, self.width, self.height)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the .tif and .tiff files below a folder, in the order of names."""
    system, inner = _filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path.removesuffix(inner)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and (info.is_file or f.path.lower().endswith((".tif", ".tiff"))))


def _directories(file: pa.NativeFile) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and the tags of each image of a file, classic or big."""
    head = file.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    counter, entry, word = ("Q", "HHQ8s", "Q") if big else ("H", "HHI4s", "I")
    at = struct.unpack(order + word, head[8:16] if big else head[4:8])[0]
    step, wide = struct.calcsize(order + entry), struct.calcsize(order + counter)
    while at:
        n = struct.unpack(order + counter, file.read_at(wide, at))[0]
        body = file.read_at(n * step + struct.calcsize(word), at + wide)
        tags = {}
        for tag, kind, count, inline in struct.iter_unpack(order + entry, body[: n * step]):
            if kind in TYPES:
                size = struct.calcsize(order + TYPES[kind]) * count
                data = inline[:size] if size <= len(inline) else file.read_at(size, struct.unpack(order + word, inline)[0])
                tags[tag] = struct.unpack(f"{order}{count}{TYPES[kind]}", data)
        yield order, tags
        at = struct.unpack(order + word, body[n * step :])[0]


def _place(tags: dict[int, tuple]) -> tuple[float, float, float, float, str | None]:
    """Upper left corner, size of a pixel and reference system. Files without any have pixels of 1 below (0, 0)."""
    keys, doubles = tags.get(GEO_KEYS, ()), tags.get(GEO_DOUBLES, ())
    geo = {k: value if where == 0 else doubles[value] for k, where, _, value in (keys[i : i + 4] for i in range(4, len(keys) - 3, 4)) if where in (0, GEO_DOUBLES)}
    code = geo.get(PROJECTED) or geo.get(GEOGRAPHIC)
    crs = "sinusoidal" if geo.get(PROJECTION) == SINUSOIDAL else f"EPSG:{code}" if code and code != OWN_CODE else None
    if TRANSFORM in tags:
        a, b, _, x0, d, e, _, y0 = tags[TRANSFORM][:8]
        if b or d:
            raise ValueError("turned images are not read")
        dx, dy = a, -e
    else:
        dx, dy = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y = tags.get(TIEPOINT, (0.0,) * 5)[:5]
        x0, y0 = x - i * dx, y + j * dy
    half = 0.5 if geo.get(RASTER_TYPE) == 2 else 0.0
    return x0 - half * dx, y0 + half * dy, dx, dy, crs


def images(file: pa.NativeFile) -> list[Image]:
    """The full image and its reduced ones, largest first; masks are left out. Reduced images take their place from the full one."""
    found: list[Image] = []
    for order, t in _directories(file):
        if t.get(SUBFILE, (0,))[0] & 4:
            continue
        width, height, bands = t[WIDTH][0], t[HEIGHT][0], t.get(BANDS, (1,))[0]
        kinds = set(zip(t.get(SAMPLE_FORMAT, (1,) * bands), t.get(BITS, (1,) * bands), strict=False))
        kind, bits = next(iter(kinds))
        if len(kinds) > 1 or kind not in SAMPLES or bits not in (8, 16, 32, 64):
            raise ValueError(f"samples of {kinds} are not read")
        tile = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]) if TILES in t else (min(t.get(ROWS_OF_STRIP, (height,))[0], height), width)
        x0, y0, dx, dy, crs = _place(t)
        text = t.get(NODATA, (b"",))[0].rstrip(b"\0 ").decode()
        image = Image(width, height, bands, tile, t.get(TILES) or t[STRIPS], t.get(TILE_SIZES) or t[STRIP_SIZES], t.get(COMPRESSION, (NONE,))[0], t.get(PREDICTOR, (1,))[0],
                      t.get(PLANAR, (1,))[0] == 2, f"{order}{SAMPLES[kind]}{bits // 8}", x0, y0, dx, dy, crs, float(text) if text else None)
        if found and t.get(SUBFILE, (0,))[0] & 1:
            full = found[0]
            image = replace(image, x0=full.x0, y0=full.y0, dx=full.dx * full.width / width, dy=full.dy * full.height / height, crs=full.crs, nodata=full.nodata if image.nodata is None else image.nodata)
        elif found:
            continue
        found.append(image)
    return sorted(found, key=lambda i: -i.width)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early; 256 clears the table, 257 ends."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, last = list(start), [], b""
    held = have = 0
    width = 9
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _pixels(image: Image, data: bytes) -> np.ndarray:
    """(rows, columns, bands) of one tile or strip."""
    rows, columns = image.tile
    bands, dtype = 1 if image.separate else image.bands, np.dtype(image.dtype)
    line = columns * bands * dtype.itemsize
    if image.compression in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif image.compression == ZSTD:
        data = pa.CompressedInputStream(pa.BufferReader(data), "zstd").read()
    elif image.compression == LZW:
        data = _lzw(data)
    elif image.compression != NONE:
        raise ValueError(f"compression {image.compression} is not read")
    rows = min(rows, len(data) // line)
    data = data[: rows * line]
    if image.predictor == 3:  # differences of bytes, the bytes of a row's samples sorted by weight
        steps = np.frombuffer(data, np.uint8).reshape(rows, -1, bands).cumsum(axis=1, dtype=np.uint8)
        values = steps.reshape(rows, dtype.itemsize, -1).transpose(0, 2, 1).copy().view(f">f{dtype.itemsize}")
        return values.reshape(rows, columns, bands)
    values = np.frombuffer(data, dtype).reshape(rows, columns, bands)
    if image.predictor == 2:
        native = values.astype(dtype.newbyteorder("="))
        values = native.view(f"u{dtype.itemsize}").cumsum(axis=1, dtype=f"u{dtype.itemsize}").view(native.dtype)
    return values


@dataclass
class _Share(InputPartition):
    path: str
    part: int
    parts: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.resolution = float(options.get("resolution", 0))
        self.nodata = float(options["nodata"]) if "nodata" in options else None
        self.share = int(options.get("share", SHARE))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps the bounds of pixels; Spark applies every filter again, since whole tiles are cut to whole pixels only."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in ("r", "c", "x", "y", "band"):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low.get(name, -math.inf), f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high.get(name, math.inf), f.value)
                if isinstance(f, In) and (values := [v for v in f.value if v is not None]):
                    self.low[name], self.high[name] = max(self.low.get(name, -math.inf), min(values)), min(self.high.get(name, math.inf), max(values))
            yield f

    def partitions(self) -> list[InputPartition]:
        return [_Share(path, k, n) for path, size in files(self.path) for n in [max(1, math.ceil(size / self.share))] for k in range(n)]

    def _window(self, image: Image) -> tuple[int, int, int, int]:
        """First and last row and column that the bounds leave, a pixel more on each side of bounds in coordinates."""
        low, high = (lambda n: self.low.get(n, -math.inf)), (lambda n: self.high.get(n, math.inf))
        top, bottom = (image.y0 - high("y")) / image.dy - 1.5, (image.y0 - low("y")) / image.dy + 0.5
        left, right = (low("x") - image.x0) / image.dx - 1.5, (high("x") - image.x0) / image.dx + 0.5
        cut = lambda a, b, n: (math.ceil(max(a, 0)), math.floor(min(b, n - 1)))
        rows, columns = cut(max(top, low("r")), min(bottom, high("r")), image.height), cut(max(left, low("c")), min(right, high("c")), image.width)
        return rows[0], rows[1], columns[0], columns[1]

    def read(self, partition: _Share | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, inner = _filesystem(partition.path)
        with system.open_input_file(inner) as file:
            levels = images(file)
            image = next((i for i in reversed(levels) if i.dx <= self.resolution), levels[0])
            r0, r1, c0, c1 = self._window(image)
            high, wide = image.tile
            across, down = math.ceil(image.width / wide), math.ceil(image.height / high)
            wanted = [b for b in range(image.bands) if self.low.get("band", 1) <= b + 1 <= self.high.get("band", image.bands)]
            if r0 > r1 or c0 > c1 or not wanted:
                return
            touched = [(p, i, j) for p in (wanted if image.separate else [0]) for i in range(r0 // high, r1 // high + 1) for j in range(c0 // wide, c1 // wide + 1)]
            for p, i, j in touched[len(touched) * partition.part // partition.parts : len(touched) * (partition.part + 1) // partition.parts]:
                at = (p * down + i) * across + j
                if image.sizes[at] == 0:  # a sparse file leaves out tiles without data
                    continue
                values = _pixels(image, file.read_at(image.sizes[at], image.offsets[at]))
                top, left = max(r0, i * high), max(c0, j * wide)
                values = values[top - i * high : min(r1 + 1 - i * high, high), left - j * wide : min(c1 + 1 - j * wide, wide)]
                for b in [p] if image.separate else wanted:
                    yield self._batch(partition.path, image, b + 1, top, left, values[:, :, 0 if image.separate else b])

    def _batch(self, path: str, image: Image, band: int, top: int, left: int, values: np.ndarray) -> pa.RecordBatch:
        rows, columns = values.shape
        r, c = np.repeat(np.arange(top, top + rows, dtype=np.int32), columns), np.tile(np.arange(left, left + columns, dtype=np.int32), rows)
        dn = values.astype(np.float64).ravel()
        nodata = next((v for v in (self.nodata, image.nodata) if v is not None), 0.0)
        out = [pa.repeat(pa.scalar(path, pa.string()), len(dn)), pa.repeat(pa.scalar(image.crs, pa.string()), len(dn)), pa.array(np.full(len(dn), band, np.int32)), pa.array(r), pa.array(c),
               pa.array(image.x0 + (c + 0.5) * image.dx), pa.array(image.y0 - (r + 0.5) * image.dy), pa.array(dn, mask=np.isnan(dn) | (dn == nodata))]
        return pa.RecordBatch.from_arrays(out, names=["path", "crs", "band", "r", "c", "x", "y", "dn"])


class GeoTiff(DataSource):
    """Options: path (a file or a folder), resolution (of the reduced images the coarsest with pixels no larger), nodata, share."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, **options: float) -> DataFrame:
    """(path, crs, band, r, c, x, y, dn) of the pixels of a file or of all files below a folder; filter it to read a window.

    (x, y) is a pixel's centre in the file's system. dn is null where a file has no data: the option, else the file's own mark, else 0; a
    tile that the file leaves out gives no rows. Whole numbers beyond 2^53 are rounded.
    """
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("geotiff").options(**options).load(path)


def describe(path: str) -> Image:
    """The full image of one file, from its directory alone."""
    system, inner = _filesystem(path)
    with system.open_input_file(inner) as file:
        return images(file)[0]


def _native(crs: str | None, lon: Column, lat: Column) -> tuple[Column, Column]:
    code = int(crs[5:]) if (crs or "").startswith("EPSG:") else 0
    if code == 4326:
        return lon, lat
    if crs == "sinusoidal":
        return sinusoidal(lon, lat)
    if code == 3857:
        return F.radians(lon) * AXIS, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * AXIS
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return utm(lon, lat, code % 100, code > 32700)
    raise ValueError(f"no projection for {crs}")


def on_grid(spark: SparkSession, path: str, grid: Grid, *, scale: float = 1.0, offset: float = 0.0, **options: float) -> DataFrame:
    """(r, c, band, value) of the cells of a grid in longitude and latitude: dn * scale + offset of the pixel that holds a cell's centre.

    Cells outside the file have no rows, cells without data a null value. The file is read within the rows and columns that cells ask for.
    """
    image = describe(path)
    r, c = F.floor(F.col("id") / grid.width).cast("int").alias("r"), (F.col("id") % grid.width).cast("int").alias("c")
    cells = spark.range(grid.width * grid.height).select(r, c)
    sr, sc = image.grid().place(*_native(image.crs, *grid.centre(F.col("r"), F.col("c"))))
    cells = cells.select("r", "c", sr.cast("int").alias("sr"), sc.cast("int").alias("sc")).filter("sr >= 0 and sc >= 0")
    r0, r1, c0, c1 = (int(v) if v is not None else -1 for v in cells.agg(F.min("sr"), F.max("sr"), F.min("sc"), F.max("sc")).first())
    source = read(spark, path, **options).filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).select(F.col("r").alias("sr"), F.col("c").alias("sc"), "band", "dn")
    return cells.join(source, ["sr", "sc"]).select("r", "c", "band", (F.col("dn") * scale + offset).alias("value"))


def _header(grid: Grid, epsg: int, bands: int, dtype: str, side: int, nodata: float, tiles: dict[int, int]) -> bytes:
    """Everything before the tiles of a big, tiled file: tiles holds the bytes of each that is there; they follow in their order."""
    n = math.ceil(grid.width / side) * math.ceil(grid.height / side)
    sizes = np.zeros(n, "<u8")
    sizes[list(tiles)] = list(tiles.values())
    kind = np.dtype(dtype)
    w, h = grid.cell
    geographic = 4000 <= epsg < 5000
    keys = [1, 1, 0, 3, MODEL_TYPE, 0, 1, 2 if geographic else 1, RASTER_TYPE, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, epsg]
    sample = {v: k for k, v in SAMPLES.items()}[kind.kind]
    fields = [(WIDTH, 4, [grid.width]), (HEIGHT, 4, [grid.height]), (BITS, 3, [kind.itemsize * 8] * bands), (COMPRESSION, 3, [DEFLATE]), (PHOTOMETRIC, 3, [1]), (BANDS, 3, [bands]), (PLANAR, 3, [1]), (TILE_WIDTH, 4, [side]),
              (TILE_HEIGHT, 4, [side]), (TILES, 16, None), (TILE_SIZES, 16, sizes.tolist()), (EXTRA, 3, [0] * (bands - 1)), (SAMPLE_FORMAT, 3, [sample] * bands), (PIXEL_SCALE, 12, [w, h, 0.0]),
              (TIEPOINT, 12, [0.0, 0.0, 0.0, grid.xmin, grid.ymax, 0.0]), (GEO_KEYS, 3, keys), (NODATA, 2, [f"{nodata:g}".encode() + b"\0"])]
    fields = [f for f in fields if f[2] is None or f[2]]
    count = lambda kind_, v: n if v is None else len(v[0]) if kind_ == 2 else len(v)
    width_of = lambda kind_, v: struct.calcsize("<" + TYPES[kind_]) * count(kind_, v)
    after = 16 + 8 + 20 * len(fields) + 8
    start = after + sum(width_of(k, v) for _, k, v in fields if width_of(k, v) > 8)
    offsets = np.where(sizes > 0, start + np.cumsum(sizes) - sizes, 0)
    body, more = b"", b""
    for tag, k, v in fields:
        v = offsets.astype("<u8").tolist() if v is None else v
        data = struct.pack(f"<{count(k, v)}{TYPES[k]}", *v)
        body += struct.pack("<HHQ", tag, k, count(k, v)) + (data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", after + len(more)))
        more += data if len(data) > 8 else b""
    return b"II" + struct.pack("<HHHQQ", 43, 8, 0, 16, len(fields)) + body + struct.pack("<Q", 0) + more


def write(cells: DataFrame, folder: str, grid: Grid, bands: list[str], *, name: str = "file", epsg: int = 4326, dtype: str = "float32", side: int = 256, nodata: float = 0.0) -> DataFrame:
    """Writes (name, r, c, *bands) as one tiled, deflated file for each name, ``folder``/name.tif; gives (path, tiles, bytes).

    Null values and missing cells become ``nodata``, tiles without cells are left out; cells outside the grid and rows without a name are
    dropped, and of rows for the same cell the one with the greatest values stays. Tiles are made apart and then pass through one task for
    each file, a tile at a time. A file appears under its name when it is whole, so a task may run twice.
    """
    across = math.ceil(grid.width / side)
    inside = cells.filter(F.col("r").between(0, grid.height - 1) & F.col("c").between(0, grid.width - 1) & F.col(name).isNotNull())
    tiled = inside.select(F.col(name).cast("string").alias("file"), (F.floor(F.col("r") / side) * across + F.floor(F.col("c") / side)).cast("long").alias("tile"), F.col("r").cast("int"), F.col("c").cast("int"), *[F.col(b).cast("double").alias(f"b{i}") for i, b in enumerate(bands)])
    values = [f"b{i}" for i in range(len(bands))]

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(values, na_position="first")
        tile = np.full((side, side, len(values)), nodata, "<" + np.dtype(dtype).str[1:])
        tile[rows.r.to_numpy() % side, rows.c.to_numpy() % side] = rows[values].fillna(nodata).to_numpy()
        return pd.DataFrame({"file": [key[0]], "tile": [key[1]], "data": [zlib.compress(tile.tobytes())]})

    tiles = saved(tiled.groupBy("file", "tile").applyInPandas(packed, "file string, tile long, data binary"), "tiles")

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [_header(grid, epsg, len(values), dtype, side, nodata, {t["tile"]: t["size"] for t in sizes}) for sizes in batch["sizes"]]
            yield pd.DataFrame({"file": batch["file"], "tile": -1, "data": data})

    sizes = tiles.groupBy("file").agg(F.collect_list(F.struct("tile", F.length("data").alias("size"))).alias("sizes"))
    parts = sizes.mapInPandas(headed, "file string, tile long, data binary").unionByName(tiles)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, system, scratch, inner = [], None, None, "", ""

        def close() -> None:
            out.close()
            system.move(scratch, inner)

        for batch in batches:
            for file, tile, data in zip(*(batch.column(n) for n in ("file", "tile", "data")), strict=True):
                if tile.as_py() < 0:
                    if out is not None:
                        close()
                    path = f"{folder.rstrip('/')}/{file.as_py()}.tif"
                    system, inner = _filesystem(path)
                    system.create_dir(inner.rpartition("/")[0], recursive=True)
                    scratch = f"{inner}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(scratch)
                    done.append([path, -1, 0])
                out.write(data.as_buffer())
                done[-1][1:] = [done[-1][1] + 1, done[-1][2] + len(data.as_buffer())]
        if out is not None:
            close()
            yield pa.RecordBatch.from_pylist([{"path": p, "tiles": n, "bytes": b} for p, n, b in done], pa.schema([("path", pa.string()), ("tiles", pa.int64()), ("bytes", pa.int64())]))

    ordered = parts.repartition("file").sortWithinPartitions("file", "tile")
    return saved(ordered.mapInArrow(stored, "path string, tiles long, bytes long"), "files")
