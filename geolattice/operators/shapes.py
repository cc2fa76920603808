"""What the form of a polygon tells: the least rectangle around it, how long it is for its width, and how compact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "poly {}, width double, length double, elongation double, area double, outline double, compactness double"


def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of points, counter-clockwise, without those on a side."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(p: np.ndarray) -> tuple[float, float]:
    """(shorter, longer) side of the rectangle of least area around points, to six decimals, and of equals the narrowest: one of its sides
    lies on the hull.

    Rotating calipers: as the side turns once around, so do the corners that are farthest along it, across it and back.
    """
    h = hull(p)
    if len(h) < 3:
        return 0.0, float(np.hypot(*(h[-1] - h[0]))) if len(h) else 0.0
    n, best = len(h), (np.inf, 0.0, 0.0)
    right = top = left = 0
    for i in range(n):
        u = h[(i + 1) % n] - h[i]
        u = u / np.hypot(*u)
        v = np.array([-u[1], u[0]])
        if i == 0:
            right, top, left = (int(np.argmax(h @ w)) for w in (u, v, -u))
        while (h[(right + 1) % n] - h[right]) @ u > 0:
            right = (right + 1) % n
        while (h[(top + 1) % n] - h[top]) @ v > 0:
            top = (top + 1) % n
        while (h[(left + 1) % n] - h[left]) @ u < 0:
            left = (left + 1) % n
        a, b = (h[right] - h[left]) @ u, (h[top] - h[i]) @ v
        best = min(best, (round(a * b, 6), min(a, b), max(a, b)))
    return float(best[1]), float(best[2])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for points in batch.column("points"):
            p = points.values
            xy = np.column_stack([p.field("x").to_numpy(zero_copy_only=False), p.field("y").to_numpy(zero_copy_only=False)])
            next_ = np.roll(xy, -1, axis=0)
            area, outline = abs(float((xy[:, 0] * next_[:, 1] - next_[:, 0] * xy[:, 1]).sum())) / 2, float(np.hypot(*(next_ - xy).T).sum())
            width, length = least_rectangle(xy)
            rows.append((width, length, length / max(width, 1.0), area, outline, 4 * np.pi * area / outline**2 if outline else 0.0))
        columns = np.array(rows, float).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays([batch.column("poly"), *[pa.array(columns[:, k]) for k in range(6)]], names=["poly", "width", "length", "elongation", "area", "outline", "compactness"])


def shape_features(rings: DataFrame) -> DataFrame:
    """(poly, width, length, elongation, area, outline, compactness) of the outer ring of each polygon (poly, ring, points: array of struct x, y).

    width and length are the sides of the least rectangle; elongation is their ratio, a width under 1 counting as 1; compactness is 1 for a
    circle. Polygons stay in their rows and tasks: nothing is exchanged. Rings without points, or with null coordinates, give no row.
    """
    outer = rings.filter((F.col("ring") == 0) & (F.size("points") > 0) & F.forall("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())).select("poly", "points")
    return outer.mapInArrow(_features, SCHEMA.format(outer.schema["poly"].dataType.simpleString()))
