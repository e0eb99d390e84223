"""Histogram algebra on arrays of bin weights, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(bins: Column) -> Column:
    return F.aggregate(bins, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda computes what stands outside it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalised(bins: Column) -> Column:
    return let(bins, lambda b: let(total(b), lambda t: F.transform(b, lambda x: x / t)))


def weighted(bins: Column, weights: list[float]) -> Column:
    """Sum of the bins, each times its fixed weight."""
    return total(F.zip_with(bins, F.lit(weights), lambda x, w: x * w))


def centres(n: int, low: float, high: float) -> list[float]:
    return [low + (i + 0.5) * ((high - low) / n) for i in range(n)]


def expected(bins: Column, n: int, low: float = 0.0, high: float = 1.0) -> Column:
    """Mean of the histogram over n bins on [low, high]."""
    return weighted(bins, centres(n, low, high))


def expected_absolute(bins: Column, n: int, low: float = -1.0, high: float = 1.0) -> Column:
    return weighted(bins, [abs(c) for c in centres(n, low, high)])


def variance(bins: Column, n: int, low: float = 0.0, high: float = 1.0) -> Column:
    """E[x^2] - E[x]^2, at least 0."""
    square = weighted(bins, [c * c for c in centres(n, low, high)])
    return let(expected(bins, n, low, high), lambda mean: F.greatest(F.lit(0.0), square - mean * mean))


def parts_within(n: int, threshold: float) -> list[float]:
    """How much of each of n bins on [-1, 1] is within +-threshold."""
    width = 2.0 / n
    return [max(0.0, min(1.0, (min(-1.0 + (i + 1) * width, threshold) - max(-1.0 + i * width, -threshold)) / width)) for i in range(n)]


def share_within(bins: Column, n: int, threshold: float) -> Column:
    """Mass of a histogram on [-1, 1] within +-threshold: the cumulative sum, interpolated inside the bins of both ends."""
    return weighted(bins, parts_within(n, threshold))


def share_outside(bins: Column, n: int, threshold: float) -> Column:
    return weighted(bins, [1 - x for x in parts_within(n, threshold)])


def without_prior(bins: Column, prior: Column) -> Column:
    """bins divided by the prior's (both over the same bins), normalised again."""
    return normalised(F.zip_with(bins, prior, lambda b, p: (b + 1e-300) / p))


def unpacked_bins(bins: Column) -> Column:
    """Both connections' histograms of a two-connection LSV that stores only the first's."""
    return F.array(bins, F.reverse(bins))


def unpacked_means(mean: Column) -> Column:
    return F.array(mean, 1 - mean)


def exclusion_inclusion(mean: Column) -> Column:
    """(-mean, 0) for a negative mean, else (0, mean)."""
    return F.when(mean < 0, F.array(-mean, F.lit(0.0))).otherwise(F.array(F.lit(0.0), mean))
