"""Scans of landed provider payloads (JSON files) into long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropspark.constants import BAND_KEYS, OPTICAL_KEYS, PAYLOAD_VARS, RADAR_KEYS, WEATHER_VARS
from cropspark.functions.numeric import finite_or_null
from cropspark.operators.lookup import latest_by
from cropspark.schemas import HOURLY_PAYLOAD, WEATHER_PAYLOAD, statistics_payload


def weather_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEATHER_PAYLOAD).json(path)


CORRUPT = "_corrupt"


def sifted(spark: SparkSession, path: str, schema: T.StructType, series: str) -> DataFrame:
    """A stream of landed payload files, each payload with its file and, where it is refused, the reason.

    Payloads are read one per line and permissively: what does not parse keeps its text. Refused are payloads that are no JSON, those
    of which only a part fits the schema, those without a site, and those without a time in ``series``. Each file is met once.
    """
    wanted = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.readStream.schema(wanted).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    parsed = F.lit(False)
    for f in schema.fields:
        parsed = parsed | F.col(f.name).isNotNull()
    broken = F.col(CORRUPT).isNotNull()
    reason = (
        F.when(broken & ~parsed, "no json")
        .when(broken, "half parsed")
        .when(F.col("site_id").isNull(), "no site")
        .when(F.coalesce(F.size(f"{series}.time"), F.lit(0)) <= 0, "no series")
    )
    return rows.select(*schema.fieldNames(), F.col("_metadata.file_name").alias("file"), F.col(CORRUPT).alias("raw"), reason.alias("reason"))


def accepted(sifted_rows: DataFrame) -> DataFrame:
    return sifted_rows.filter(F.col("reason").isNull()).drop("file", "raw", "reason")


def refused(sifted_rows: DataFrame) -> DataFrame:
    """The side table: file, reason, and the text where there was no payload to keep."""
    return sifted_rows.filter(F.col("reason").isNotNull()).select("file", "reason", "site_id", "raw")


def _series(path: str) -> Column:
    """A missing key reads as an empty series; zipping pads it with NULL."""
    return F.coalesce(F.col(path), F.array().cast("array<double>"))


def daily_from_payload(payloads: DataFrame) -> DataFrame:
    """Parallel arrays of six variables to one row per (site, day). Absent keys stay NULL."""
    zipped = F.arrays_zip(F.col("daily.time").alias("time"), *[_series(f"daily.{v}").alias(v) for v in PAYLOAD_VARS])
    rows = payloads.select("site_id", F.inline(zipped))
    return rows.select(
        "site_id",
        F.to_date("time").alias("date"),
        *[finite_or_null(F.col(src)).alias(dst) for src, dst in zip(PAYLOAD_VARS, WEATHER_VARS)],
    )


def hourly_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOURLY_PAYLOAD).json(path)


def hourly_from_payload(payloads: DataFrame) -> DataFrame:
    """A shorter humidity series leaves NULL humidity in its missing tail."""
    zipped = F.arrays_zip(
        F.col("hourly.time").alias("time"),
        _series("hourly.temperature_2m").alias("temp"),
        _series("hourly.relative_humidity_2m").alias("rh"),
    )
    rows = payloads.select("site_id", F.inline(zipped))
    return rows.select(
        "site_id",
        F.to_timestamp_ntz("time").alias("ts"),
        finite_or_null(F.col("temp")).alias("temp"),
        finite_or_null(F.col("rh")).alias("rh"),
    )


def statistics_payloads(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.schema(statistics_payload(keys)).json(path)


def observations(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """One row per interval in which every requested output has samples and a usable mean."""
    rows = payloads.select("site_id", F.explode("data").alias("iv"))
    usable = F.lit(True)
    for k in keys:
        stats = F.col(f"iv.outputs.{k}.bands.B0.stats")
        usable = usable & (F.coalesce(stats["sampleCount"], F.lit(0)) > 0)
        usable = usable & stats["mean"].isNotNull() & ~F.isnan(stats["mean"])
    return rows.filter(usable).select(
        "site_id",
        F.to_date(F.substring("iv.interval.to", 1, 10)).alias("sensing_date"),
        *[F.col(f"iv.outputs.{k}.bands.B0.stats.mean").alias(k) for k in keys],
    )


def optical_observations(payloads: DataFrame) -> DataFrame:
    return observations(payloads, OPTICAL_KEYS)


def radar_observations(payloads: DataFrame) -> DataFrame:
    return observations(payloads, RADAR_KEYS)


def band_observations(payloads: DataFrame) -> DataFrame:
    return observations(payloads, BAND_KEYS)


def landed_with_data(payloads: DataFrame) -> DataFrame:
    """An empty pull is never recorded as a fact."""
    return payloads.filter(F.coalesce(F.size("data"), F.lit(0)) > 0)


def sites_to_reingest(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """Sites without a single landed row: candidates for another pull."""
    return sites.join(facts.select("site_id"), "site_id", "left_anti")


def latest_pull(rows: DataFrame, keys: list[str], pulled: str = "pulled_at") -> DataFrame:
    """One row for each key, from its latest pull: a second, overlapping pull replaces the days it brings again and no others."""
    keep = [c for c in rows.columns if c not in (*keys, pulled)]
    return latest_by(rows, keys, [pulled, *[c for c in keep]], keep)
