"""Scalar helpers as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = 50_000


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def logistic(x: Column, midpoint: float, steepness: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(float(steepness)) * (x - F.lit(float(midpoint)))))


def inv_logistic(x: Column, midpoint: float, steepness: float) -> Column:
    return F.lit(1.0) - logistic(x, midpoint, steepness)


def target_band(x: Column, lo: float, hi: float) -> Column:
    """1 within [lo, hi], falling to 0 over the band's width on either side."""
    width = max(hi - lo, 1e-6)
    return F.when((x >= lo) & (x <= hi), 1.0).when(x < lo, clamp(1 - (F.lit(lo) - x) / width)).otherwise(clamp(1 - (x - F.lit(hi)) / width))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, total(xs) / F.size(xs)).otherwise(0.0)


def sample_std(xs: Column, m: Column) -> Column:
    """The sample standard deviation of xs about its mean m; 0 for one value or none."""
    square = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(xs) > 1, F.sqrt(square / (F.size(xs) - 1))).otherwise(0.0)


def finite_unit(x: Column, default: float = 0.0) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, default).otherwise(clamp(x))


def surprisal(rank: Column) -> Column:
    """Negative log probability of a word by its rank, null for words outside the list."""
    return F.when(rank.isNull(), math.log(VOCABULARY * math.log(VOCABULARY))).otherwise(F.log((rank + 2) * math.log(VOCABULARY + 1)))


def entropy_hint(word: Column, rank: Column) -> Column:
    """How open a word's choice is, by its rank."""
    short = ~word.rlike(r"^\p{L}+$") | (F.length(word) < 4)
    return F.when(short, 0.05).when(rank.isNull(), 0.92).when(rank <= 80, 0.08).when(rank <= 250, 0.45).otherwise(0.78)


def keyed_hash(parts: list[Column], seed: Column | int) -> Column:
    """The first 28 bits of an MD5 over the seed and the parts."""
    joined = F.concat_ws("\x1f", F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), *parts)
    return F.conv(F.substring(F.md5(joined), 1, 7), 16, 10).cast("long")


def uniform(parts: list[Column], seed: int) -> Column:
    """A number in [0, 1) by the same hash."""
    return keyed_hash(parts, seed) / F.lit(float(1 << 28))
