"""Grids over a box of longitude and latitude: cell centres, areas, and where they fall in a projected source."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Radius of the sphere of the sinusoidal projection; semi-major axis, flattening and scale of UTM on WGS84.
SPHERE, AXIS, FLATTENING, SCALE = 6371007.181, 6378137.0, 1 / 298.257223563, 0.9996


@dataclass(frozen=True)
class Grid:
    """Rows count from the top, columns from the left."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    width: int
    height: int

    @property
    def cell(self) -> tuple[float, float]:
        return (self.xmax - self.xmin) / self.width, (self.ymax - self.ymin) / self.height

    def centre(self, r: Column, c: Column) -> tuple[Column, Column]:
        w, h = self.cell
        return F.lit(self.xmin) + (c + 0.5) * w, F.lit(self.ymax) - (r + 0.5) * h

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(row, column) of a point; both are -1 outside."""
        w, h = self.cell
        r, c = F.floor((F.lit(self.ymax) - y) / h), F.floor((x - F.lit(self.xmin)) / w)
        inside = r.between(0, self.height - 1) & c.between(0, self.width - 1)
        return F.when(inside, r).otherwise(-1), F.when(inside, c).otherwise(-1)

    def hectares(self) -> float:
        """Of a cell, by the metres of a degree at the grid's centre. The factors are those of ``metres_per_degree``."""
        phi = math.radians((self.ymin + self.ymax) / 2)
        lon = 111412.84 * math.cos(phi) - 93.5 * math.cos(3 * phi) + 0.118 * math.cos(5 * phi)
        lat = 111132.92 - 559.82 * math.cos(2 * phi) + 1.175 * math.cos(4 * phi) - 0.0023 * math.cos(6 * phi)
        w, h = self.cell
        return w * lon * h * lat / 10000


def crs(code: Column) -> Column:
    """Struct (kind, zone, south) of an EPSG code: geographic, mercator or UTM north or south; kind is null for others."""
    north, south = code.between(32601, 32660), code.between(32701, 32760)
    kind = F.when(code == 4326, "geographic").when(code == 3857, "mercator").when(north | south, "utm")
    return F.struct(kind.alias("kind"), F.when(north | south, code % 100).cast("int").alias("zone"), south.alias("south"))


def sinusoidal(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * F.cos(F.radians(lat)) * SPHERE, F.radians(lat) * SPHERE


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing in metres, by the series in the third flattening (good to well under a millimetre in a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    east = eta + sum((a * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, a in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, a in enumerate(alpha)), F.lit(0.0))
    return 500000 + SCALE * radius * east, (1e7 if south else 0.0) + SCALE * radius * north


def projected_box(grid: Grid) -> tuple[float, float, float, float]:
    """The box, in the sinusoidal projection, around the grid's four corners."""
    xs, ys = zip(*[(math.radians(x) * math.cos(math.radians(y)) * SPHERE, math.radians(y) * SPHERE) for x in (grid.xmin, grid.xmax) for y in (grid.ymin, grid.ymax)], strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def lookup(cells: DataFrame, grid: Grid, source: Grid) -> DataFrame:
    """Adds (sr, sc): the cell of a sinusoidal source grid in which each cell's centre falls, -1 outside."""
    x, y = sinusoidal(*grid.centre(F.col("r"), F.col("c")))
    sr, sc = source.place(x, y)
    return cells.withColumns({"sr": sr, "sc": sc})


def gather(cells: DataFrame, source: DataFrame) -> DataFrame:
    """Cells with (sr, sc) and the values of the source's cell (r, c, ...), null outside."""
    return cells.join(source.withColumnsRenamed({"r": "sr", "c": "sc"}), ["sr", "sc"], "left")
