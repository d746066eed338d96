"""Rules that read survey and farm attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cropspark.constants import DEFAULT_PRICE_USD_PER_T, FALLBACK_CROP_NAME, PRICE_USD_PER_T
from cropspark.functions.numeric import half_even


def dominant_crop(crops: Column) -> Column:
    """First recorded crop of an array, trimmed; the fallback when nothing usable is recorded."""
    return F.coalesce(F.nullif(F.trim(F.get(crops, F.lit(0))), F.lit("")), F.lit(FALLBACK_CROP_NAME))


def dominant_crop_text(crops: Column) -> Column:
    """The same for a comma-separated text; blank text falls back, a blank first item stays blank."""
    return F.when(
        F.trim(crops) != F.lit(""), F.trim(F.split_part(crops, F.lit(","), F.lit(1)))
    ).otherwise(F.lit(FALLBACK_CROP_NAME))


def farm_size_ha(text: Column) -> Column:
    """Leading number of a text such as '3.5 ha'; 1.0 when there is none."""
    return F.coalesce(F.split_part(F.trim(text), F.lit(" "), F.lit(1)).try_cast("double"), F.lit(1.0))


def price_per_t(crop: Column) -> Column:
    key = F.lower(crop)
    price = F.lit(DEFAULT_PRICE_USD_PER_T)
    for name, value in PRICE_USD_PER_T.items():
        price = F.when(key == F.lit(name), F.lit(value)).otherwise(price)
    return price


def expected_yield(reported: Column, ndvi: Column) -> Column:
    """Reported yield when positive, else an estimate from greenness (a missing scene reads as 0)."""
    estimate = F.lit(1.5) + (F.coalesce(ndvi, F.lit(0.0)) - F.lit(0.4)) * F.lit(3.5)
    return F.when(reported > 0, reported).otherwise(
        half_even(F.greatest(F.lit(0.5), F.least(F.lit(5.0), estimate)), 2)
    )


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def coping_signals(
    extension: Column, credit: Column, fertilizer: Column, diversity: Column, assets: Column, market: Column
) -> dict[str, Column]:
    def share(c: Column, default: float, full: float) -> Column:
        return F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(default)) / F.lit(full))

    return {
        "has_irrigation": F.lit(0.0),
        "has_extension_access": _flag(extension),
        "received_credit": _flag(credit),
        "used_fertilizer": _flag(fertilizer),
        "crop_diversity": share(diversity, 0.0, 4.0),
        "asset_score": share(assets, 45.0, 100.0),
        "market_access": share(market, 50.0, 100.0),
    }


def coldstart_id(lat: Column, lon: Column) -> Column:
    return F.concat(
        F.lit("coldstart-"), F.format_string("%.4f", lat), F.lit("-"), F.format_string("%.4f", lon)
    )


def usable_coordinates(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)


def coordinate_problem(lat: Column, lon: Column) -> Column:
    """Reason a row is refused, NULL for a usable one."""
    return F.when(lat.isNull() | lon.isNull(), F.lit("missing coordinates")).when(
        ~(lat.between(-90, 90) & lon.between(-180, 180)), F.lit("coordinates out of range")
    )


UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def well_formed_id(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID_PATTERN), F.lit(False))
