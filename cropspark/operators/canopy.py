"""Canopy state from optical and radar observation histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark.constants import RADAR_TOLERANCE_DAYS
from cropspark.functions.numeric import half_even
from cropspark.functions.spectral import vci, vh_vv_ratio
from cropspark.operators.lookup import nearest_date_join


def observation_history(optical: DataFrame) -> DataFrame:
    """Each observation with its site's earlier range, observation count and the next observation.

    One window by site; a site has one observation per interval, so the group is bounded.
    """
    ordered = Window.partitionBy("site_id").orderBy("sensing_date")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    site = Window.partitionBy("site_id")
    return optical.select(
        "*",
        F.min("ndvi").over(before).alias("past_min"),
        F.max("ndvi").over(before).alias("past_max"),
        F.count(F.lit(1)).over(site).alias("n_obs"),
        F.lead("sensing_date").over(ordered).alias("next_date"),
        F.lead("ndvi").over(ordered).alias("next_ndvi"),
    )


def condition(ndvi: Column, past_min: Column, past_max: Column) -> Column:
    """Condition index against the earlier range, or against itself without any history."""
    return vci(ndvi, F.coalesce(past_min, ndvi), F.coalesce(past_max, ndvi))


def with_radar(obs: DataFrame, radar: DataFrame, date: str = "sensing_date") -> DataFrame:
    """Nearest radar observation within the tolerance as rvi and vh/vv ratio; NULL without a match."""
    right = radar.select("site_id", F.col("sensing_date").alias("radar_date"), "vv", "vh", "rvi")
    joined = nearest_date_join(obs, right, "site_id", date, "radar_date", RADAR_TOLERANCE_DAYS)
    return joined.select(
        *obs.columns,
        F.col("matched.radar_date").alias("radar_date"),
        F.col("matched.rvi").alias("rvi"),
        vh_vv_ratio(F.col("matched.vv"), F.col("matched.vh")).alias("vh_vv_ratio"),
    )


def canopy_features() -> list[Column]:
    return [
        half_even(F.col("ndvi"), 4).alias("ndvi"),
        half_even(F.col("ndwi"), 4).alias("ndmi"),
        half_even(F.col("evi"), 4).alias("evi"),
        half_even(condition(F.col("ndvi"), F.col("past_min"), F.col("past_max")), 2).alias("vci"),
        half_even(F.col("rvi"), 4).alias("rvi"),
        half_even(F.col("vh_vv_ratio"), 4).alias("vh_vv_ratio"),
    ]


def own_baseline(optical: DataFrame) -> DataFrame:
    """A site's latest observation and the spread of its whole history."""
    latest = F.max_by(F.struct("sensing_date", "ndvi", "ndwi", "evi"), "sensing_date")
    return optical.groupBy("site_id").agg(
        latest.alias("latest"),
        F.count("ndvi").alias("observations"),
        F.min("ndvi").alias("ndvi_min"),
        F.max("ndvi").alias("ndvi_max"),
        F.avg("ndvi").alias("ndvi_mean"),
        F.stddev_pop("ndvi").alias("ndvi_std"),
    )
