"""k-means on standardised bands: seeding by a fixed generator, then rounds of assignment and averaging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multiplier, increment and seed of the linear congruential generator modulo 2**32.
LCG = (1664525, 1013904223, 20260820)


#: Ranges of keys whose weights a look sums.
RANGES = 256


class _Uniform:
    def __init__(self):
        self.state = LCG[2]

    def __call__(self) -> float:
        self.state = (LCG[0] * self.state + LCG[1]) % 2**32
        return self.state / 2**32


def _squared(bands: list[str], centre: list[float]) -> Column:
    return sum(((F.col(b) - float(x)) * (F.col(b) - float(x)) for b, x in zip(bands, centre, strict=True)), F.lit(0.0))


def _at_weight(df: DataFrame, weight: Column, key: str, bands: list[str], share: float) -> list[float]:
    """The row, in key order, at which the running sum of weights reaches a share of the total.

    A look sums the weights of at most RANGES ranges of keys and goes on inside the one that holds it, so the driver gets so many rows.
    """
    weighed = df.select(key, *bands, weight.alias("__w"))
    first, last = weighed.agg(F.min(key), F.max(key)).first()
    target = None
    while True:
        step = -(-(last - first + 1) // RANGES)
        inside = weighed.filter(F.col(key).between(first, last))
        sums = inside.groupBy(F.floor((F.col(key) - first) / step).alias("g")).agg(F.sum("__w").alias("w"), F.max(F.struct(key, *bands)).alias("row")).orderBy("g").collect()
        target = share * sum(r["w"] for r in sums) if target is None else target
        for r in sums:
            if target < r["w"] or r is sums[-1]:
                break
            target -= r["w"]
        if step == 1:
            return [float(r["row"][b]) for b in bands]
        first, last = first + r["g"] * step, min(last, first + (r["g"] + 1) * step - 1)


def kmeans(pixels: DataFrame, key: str, bands: list[str], k: int, max_rounds: int = 40, tolerance: float = 0.001) -> tuple[DataFrame, list[dict]]:
    """(rows of ``pixels`` with valid bands and a label, centroids in original units with their counts and the inertia).

    ``key`` is a dense long id that orders the rows. Bands are standardised by population deviation, a constant one by 1. An empty cluster
    keeps its centroid. It ends when at most max(1, tolerance * n) labels change. k centroids are all that a round sends.
    """
    valid = pixels.filter(" and ".join(f"{b} is not null" for b in bands))
    stats = valid.agg(F.count("*").alias("n"), *[f(b).alias(f"{name}_{b}") for b in bands for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if stats["n"] < k:
        raise ValueError("fewer valid rows than clusters")
    scale = {b: (float(stats[f"m_{b}"]), float(stats[f"s_{b}"]) or 1.0) for b in bands}
    rows = valid.withColumns({b: (F.col(b) - m) / s for b, (m, s) in scale.items()}).persist()
    draw = _Uniform()
    centres = [_at_weight(rows, F.lit(1.0), key, bands, draw())]
    while len(centres) < k:
        centres.append(_at_weight(rows, F.least(*[_squared(bands, c) for c in centres], F.lit(float("inf"))), key, bands, draw()))

    def nearest(cs: list[list[float]]) -> tuple[Column, Column]:
        d = F.array(*[_squared(bands, c) for c in cs])
        return F.array_position(d, F.array_min(d)) - 1, F.array_min(d)

    before = None
    for _ in range(max_rounds):
        label, d2 = nearest(centres)
        moved = F.sum((label != nearest(before)[0]).cast("long")) if before else F.count("*")
        got = {r["label"]: r for r in rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"), F.sum(d2).alias("inertia"), moved.alias("moved"), *[F.avg(b).alias(b) for b in bands]).collect()}
        if before and sum(r["moved"] for r in got.values()) <= max(1, tolerance * stats["n"]):
            break
        before, centres = centres, [[got[j][b] for b in bands] if j in got else centres[j] for j in range(k)]
    out = valid.join(rows.select(key, nearest(centres)[0].cast("int").alias("label")), key)
    summary = [{"label": j, "n": got[j]["n"] if j in got else 0, "inertia": float(got[j]["inertia"]) if j in got else 0.0} | {b: centres[j][i] * scale[b][1] + scale[b][0] for i, b in enumerate(bands)} for j in range(k)]
    return out, summary
