"""Vegetation and radar indices, condition index and crop health."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark.constants import HEALTH_BANDS, LOWEST_HEALTH
from cropspark.functions.numeric import anomaly_z, clamp01, half_even, logistic


def normalised_difference(a: Column, b: Column) -> Column:
    total = a + b
    return F.when(total == 0, F.lit(0.0)).otherwise((a - b) / total)


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def ndmi(nir: Column, swir1: Column) -> Column:
    return normalised_difference(nir, swir1)


def ndre(nir: Column, red_edge: Column) -> Column:
    return normalised_difference(nir, red_edge)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    denom = nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0)
    return F.when(denom == 0, F.lit(0.0)).otherwise(F.lit(2.5) * (nir - red) / denom)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    denom = nir + red + F.lit(soil)
    return F.when(denom == 0, F.lit(0.0)).otherwise((nir - red) * F.lit(1.0 + soil) / denom)


def rvi(vv: Column, vh: Column) -> Column:
    denom = vv + vh
    return F.when(denom > 0, F.lit(4.0) * vh / denom).when(denom.isNotNull(), F.lit(0.0))


def vh_vv_ratio(vv: Column, vh: Column) -> Column:
    return F.when(vv != 0, vh / vv)


def vci(current: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(span <= F.lit(1e-6), F.lit(50.0)).otherwise(clamp01((current - low) / span) * F.lit(100.0))


def crop_health(
    ndvi_now: Column,
    ndmi_now: Column,
    low: Column,
    high: Column,
    mean: Column,
    sd: Column,
    weights: tuple[float, float, float] = (0.4, 0.3, 0.3),
) -> Column:
    """Struct(score, vigour, moisture, anomaly, status); the band is taken from the unrounded score."""
    vigour = vci(ndvi_now, low, high) / F.lit(100.0)
    moisture = clamp01((ndmi_now + F.lit(0.2)) / F.lit(0.6))
    anomaly = logistic(anomaly_z(ndvi_now, mean, sd))
    wv, wm, wa = weights
    score = (
        F.lit(100.0)
        * (F.lit(wv) * vigour + F.lit(wm) * moisture + F.lit(wa) * anomaly)
        / F.lit(wv + wm + wa)
    )
    status = F.lit(LOWEST_HEALTH)
    for cut, name in reversed(HEALTH_BANDS):
        status = F.when(score >= F.lit(cut), F.lit(name)).otherwise(status)
    return F.struct(
        half_even(score, 1).alias("score"),
        half_even(vigour, 3).alias("vigour"),
        half_even(moisture, 3).alias("moisture"),
        half_even(anomaly, 3).alias("anomaly"),
        F.when(score.isNotNull(), status).alias("status"),
    )
