"""Numeric building blocks shared by every rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark.constants import CONSTANT_SD


def clamp01(x: Column) -> Column:
    """NULL stays NULL (plain greatest/least would turn it into a bound)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def logistic(x: Column, midpoint: float = 0.0, steepness: float = 1.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-steepness) * (x - F.lit(midpoint))))


def half_even(x: Column, digits: int) -> Column:
    """Round half to even; a missing value stays missing."""
    return F.bround(x, digits)


def finite_or_null(x: Column) -> Column:
    """NaN and infinities mean 'not observed', so they become NULL at ingest."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def anomaly_z(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd <= F.lit(1e-6), F.lit(0.0)).otherwise((value - mean) / sd)


def reference_z(value: Column, mu: Column, sigma: Column) -> Column:
    """Three-way standardisation against a reference.

    No value or no reference gives NULL; a constant or undefined spread gives 0; else the z-score.
    """
    return F.when(value.isNull() | mu.isNull(), F.lit(None).cast("double")).when(
        sigma.isNull() | (sigma <= F.lit(CONSTANT_SD)), F.lit(0.0)
    ).otherwise((value - mu) / sigma)


def noisy_or(parts: list[Column]) -> Column:
    """1 - product of (1 - p) over a fixed list of hazard columns."""
    return F.lit(1.0) - reduce(lambda acc, p: acc * (F.lit(1.0) - clamp01(p)), parts, F.lit(1.0))


def noisy_or_agg(p: Column) -> Column:
    """The same rule as an aggregate over rows; partials combine on the map side."""
    return F.lit(1.0) - F.product(F.lit(1.0) - clamp01(p))
