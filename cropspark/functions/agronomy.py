"""Thermal time, phenology, water balance and disease severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark.constants import (
    CROP_STAGES,
    DEFAULT_CROP,
    DEFAULT_KC,
    FAW_DEGREE_DAYS,
    FINAL_STAGE,
    FLOWERING,
    GDD_BASE,
    GDD_CAP,
    HEAT_THRESHOLD_C,
    KC_BY_STAGE,
    SEVERITY_BANDS,
    SPRAY_THRESHOLD,
)
from cropspark.functions.numeric import half_even


def growing_degree_days(tmin: Column, tmax: Column, base: float = GDD_BASE, cap: float = GDD_CAP) -> Column:
    upper = F.least(tmax, F.lit(cap))
    lower = F.greatest(F.least(tmin, F.lit(cap)), F.lit(base))
    return F.when(
        tmin.isNotNull() & tmax.isNotNull(), F.greatest(F.lit(0.0), (upper + lower) / F.lit(2.0) - F.lit(base))
    )


def _stage_for(gdd: Column, crop: str) -> Column:
    stage = F.lit(FINAL_STAGE)
    for threshold, name in reversed(CROP_STAGES[crop]):
        stage = F.when(gdd < F.lit(threshold), F.lit(name)).otherwise(stage)
    return stage


def phenology_stage(gdd: Column, crop: Column | None = None) -> Column:
    """First stage whose threshold lies above the accumulated heat; an unknown crop is read as maize."""
    stage = _stage_for(gdd, DEFAULT_CROP)
    if crop is None:
        return stage
    key = F.lower(F.trim(crop))
    for name in CROP_STAGES:
        if name != DEFAULT_CROP:
            stage = F.when(key == F.lit(name), _stage_for(gdd, name)).otherwise(stage)
    return stage


def crop_coefficient(stage: Column) -> Column:
    kc = F.lit(DEFAULT_KC)
    for name, value in KC_BY_STAGE.items():
        kc = F.when(stage == F.lit(name), F.lit(value)).otherwise(kc)
    return kc


def water_balance(rain_sum: Column, et0_sum: Column, stage: Column, irrigation_mm: float = 0.0) -> Column:
    """Struct(requirement_mm, rainfall_mm, deficit_mm, satisfaction) from window totals."""
    need = crop_coefficient(stage) * et0_sum
    supply = rain_sum + F.lit(irrigation_mm)
    known = need.isNotNull() & supply.isNotNull()
    satisfaction = F.when(need <= F.lit(1e-6), F.lit(1.0)).otherwise(F.least(F.lit(1.0), supply / need))
    return F.struct(
        half_even(need, 1).alias("requirement_mm"),
        half_even(supply, 1).alias("rainfall_mm"),
        F.when(known, half_even(F.greatest(F.lit(0.0), need - supply), 1)).alias("deficit_mm"),
        F.when(known, half_even(satisfaction, 3)).alias("satisfaction"),
    )


def heat_stress_days(hot_days: Column, stage: Column) -> Column:
    """Hot days count only while the crop flowers."""
    return F.when(stage == F.lit(FLOWERING), hot_days).otherwise(F.lit(0)).cast("int")


def is_hot(tmax: Column) -> Column:
    return tmax >= F.lit(HEAT_THRESHOLD_C)


def daily_severity(wet_temp: Column, wet_hours: Column) -> Column:
    """Severity value of one day; the closed temperature bands leave gaps that score 0."""
    value = F.lit(0)
    for low, high, cuts in SEVERITY_BANDS:
        inside = F.lit(0)
        for hours, points in reversed(cuts):
            inside = F.when(wet_hours >= F.lit(hours), F.lit(points)).otherwise(inside)
        value = F.when((wet_temp >= F.lit(low)) & (wet_temp <= F.lit(high)), inside).otherwise(value)
    return value


def spray_due(total: Column) -> Column:
    return total >= F.lit(SPRAY_THRESHOLD)


def fall_armyworm_generations(gdd: Column, per_generation: float = FAW_DEGREE_DAYS) -> Column:
    return half_even(gdd / F.lit(per_generation), 2)
