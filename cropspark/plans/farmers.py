"""Farmer view: latest farm, its crops, crop diversity and survey answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.functions.farmer import coordinate_problem, dominant_crop, usable_coordinates
from cropspark.operators.lookup import latest_by

SURVEY_COLUMNS = [
    "yield_value", "has_extension_access", "used_fertilizer", "received_credit", "asset_score", "market_access_score",
]


def latest_farm(farms: DataFrame) -> DataFrame:
    """Most recent farm per farmer, undated farms last, the higher id winning ties."""
    keep = [c for c in farms.columns if c != "farmer_profile_id"]
    return latest_by(farms, ["farmer_profile_id"], ["created_at", "id"], keep)


def crops_per_farm(farm_crops: DataFrame, crops: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Alphabetical crop names per farm.

    Equal names of a farm are counted before they are collected, so the collected list is as long as
    the farm has different names, and repeats are written out at the end.
    """
    rows = farm_crops if wanted is None else farm_crops.join(wanted, "farm_id", "left_semi")
    named = rows.join(crops, rows["crop_id"] == crops["id"]).groupBy("farm_id", "name").agg(F.count(F.lit(1)).cast("int").alias("n"))
    runs = F.sort_array(F.collect_list(F.struct("name", "n")))
    return named.groupBy("farm_id").agg(
        F.flatten(F.transform(runs, lambda r: F.array_repeat(r["name"], r["n"]))).alias("crops")
    )


def crop_diversity(farms: DataFrame, farm_crops: DataFrame) -> DataFrame:
    """Distinct crops over all farms of a farmer."""
    owner = farms.select(F.col("id").alias("farm_id"), "farmer_profile_id")
    return (
        farm_crops.join(owner, "farm_id")
        .groupBy("farmer_profile_id")
        .agg(F.countDistinct("crop_id").alias("crop_diversity_score"))
    )


def farmer_features(
    profiles: DataFrame, farms: DataFrame, farm_crops: DataFrame, crops: DataFrame, survey: DataFrame, all_farms: DataFrame | None = None
) -> DataFrame:
    """One row per registered farmer; farm and survey columns are NULL where nothing is recorded.

    ``farms`` may hold the latest farms alone, so that only those are located; ``all_farms`` then has every farm for the diversity.
    """
    farm = latest_farm(farms).withColumnRenamed("id", "farm_id")
    wanted = farm.select("farm_id")
    extra = [c for c in survey.columns if c != "farmer_id"]
    diversity = crop_diversity(farms if all_farms is None else all_farms, farm_crops)
    joined = (
        profiles.join(farm, F.col("user_id") == F.col("farmer_profile_id"), "left")
        .drop("farmer_profile_id")
        .join(crops_per_farm(farm_crops, crops, wanted), "farm_id", "left")
        .join(survey.withColumnRenamed("farmer_id", "user_id"), "user_id", "left")
        .join(diversity.withColumnRenamed("farmer_profile_id", "user_id"), "user_id", "left")
    )
    farm_columns = [c for c in farm.columns if c != "farmer_profile_id"]
    return joined.select(
        "user_id",
        *farm_columns,
        "crops",
        *extra,
        F.coalesce("crop_diversity_score", F.lit(0)).cast("long").alias("crop_diversity_score"),
    )


def located_farms(farms: DataFrame, farm_sites: DataFrame, sites: DataFrame) -> DataFrame:
    """Farms with the coordinates of their weather site; a broken record lies outside the globe."""
    place = sites.select("site_id", "latitude", "longitude")
    joined = farms.join(farm_sites, farms["id"] == farm_sites["farm_id"], "left").drop("farm_id").join(place, "site_id", "left")
    return joined.select(
        *farms.columns,
        "site_id",
        (F.col("latitude") + F.when(F.col("farm_size") == "unknown", F.when(F.col("state") == "P", 100.0).otherwise(0.0)).otherwise(0.0)).alias("latitude"),
        "longitude",
    )


def registered_fields(farmers: DataFrame, limit: int | None = None) -> DataFrame:
    """Fields with coordinates in id order, optionally the first ``limit`` of them."""
    rows = farmers.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        F.col("user_id").alias("field_id"), "latitude", "longitude", dominant_crop(F.col("crops")).alias("crop")
    )
    return rows.orderBy("field_id").limit(limit) if limit else rows


def split_by_coordinates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and the refused rows with the reason."""
    lat, lon = F.col("latitude"), F.col("longitude")
    refused = rows.withColumn("reason", coordinate_problem(lat, lon)).filter(F.col("reason").isNotNull())
    return rows.filter(usable_coordinates(lat, lon)), refused
