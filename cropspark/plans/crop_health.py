"""Crop health report per site from its own observation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.functions.numeric import half_even
from cropspark.plans.features import latest_canopy

NO_HISTORY = "no cloud-free Sentinel-2 observation in the last 365 days"
BASELINE_KIND = "self_history_12m"


def crop_health_report(sites: DataFrame, history: DataFrame) -> DataFrame:
    """``history`` is the last year of complete observations; sites without any keep a reason."""
    canopy = latest_canopy(history)
    joined = sites.select("site_id").join(canopy, "site_id", "left")
    seen = F.col("sensing_date").isNotNull()
    return joined.select(
        "site_id",
        seen.alias("available"),
        F.when(~seen, F.lit(NO_HISTORY)).alias("reason"),
        "crop_health",
        F.when(
            seen,
            F.struct(*[half_even(F.col(c), 3).alias(c) for c in ("ndvi", "ndwi", "evi")]),
        ).alias("observed"),
        "sensing_date",
        F.when(
            seen,
            F.struct(
                F.lit(BASELINE_KIND).alias("kind"),
                F.col("observations"),
                half_even(F.col("mean"), 3).alias("ndvi_mean"),
                half_even(F.col("sd"), 3).alias("ndvi_std"),
            ),
        ).alias("baseline"),
    )
