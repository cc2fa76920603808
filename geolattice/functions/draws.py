"""Random draws as columns, keyed by what they are for: the same in every run, order and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tries of a gamma draw; each fails with probability 0.05 at most, so all of them with 1e-20.
TRIES = 16


def uniform(*keys: Column) -> Column:
    """Between 0 and 1, neither included, from 53 bits of a hash of the keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.xxhash64(*keys), F.lit(0x9E3779B9)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def normal(*keys: Column) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*keys, F.lit(1)))) * F.cos(2 * math.pi * uniform(*keys, F.lit(2)))


def gamma(shape: Column, *keys: Column) -> Column:
    """Gamma with ``shape`` above 0 and scale 1, by the squeeze of Marsaglia and Tsang; shapes below 1 draw one above and are scaled down."""
    more = F.when(shape < 1, shape + 1).otherwise(shape)
    d = more - 1.0 / 3
    c = 1 / F.sqrt(9 * d)

    def attempt(k: Column) -> Column:
        x = normal(*keys, k)
        v = F.pow(1 + c * x, F.lit(3.0))
        fits = (v > 0) & (F.log(uniform(*keys, k, F.lit(3))) < x * x / 2 + d - d * v + d * F.log(v))
        return F.when(fits, d * v)

    # nearly all draws are done by the second try, and the others are looked at only where it fails
    rest = F.filter(F.transform(F.sequence(F.lit(2), F.lit(TRIES - 1)), attempt), lambda v: v.isNotNull())
    return F.coalesce(attempt(F.lit(0)), attempt(F.lit(1)), F.try_element_at(rest, F.lit(1))) * F.when(shape < 1, F.pow(uniform(*keys, F.lit(4)), 1 / shape)).otherwise(1.0)


def beta(a: Column, b: Column, *keys: Column) -> Column:
    x, y = gamma(a, *keys, F.lit("a")), gamma(b, *keys, F.lit("b"))
    return x / (x + y)


def jeffreys(yes: Column, no: Column, *keys: Column) -> Column:
    """A draw of the share of which ``yes`` and ``no`` have been seen, under the prior of Jeffreys."""
    return beta(yes + 0.5, no + 0.5, *keys)
