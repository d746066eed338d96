"""Domain tables derived from the warehouse tables that ship with the test data.

Every function prunes to the columns it needs and aggregates before anything is shuffled twice.
The arithmetic stays on exact binary fractions or integers, so sums do not depend on row order.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cropspark.functions.spectral import rvi
from cropspark.sources.sites import sample_sites

EPOCH = "1995-01-01"
INTERVAL_DAYS = 30
OPTICAL_OFFSET = 29
RADAR_OFFSET = 12
STATIONS = ["click", "error", "purchase", "signup", "view"]
CROP_BY_TYPE = {
    "STANDARD": "Maize", "MEDIUM": "Sorghum", "PROMO": "Rice",
    "LARGE": "Cassava", "SMALL": "maize", "ECONOMY": " Millet ",
}


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A warehouse table; its schema is read from a footer once per session."""
    path = f"{folder}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def _pct(c: str) -> Column:
    return F.round(F.col(c) * F.lit(100)).cast("long")


def _day(c: str) -> Column:
    return F.col(c).cast("date")


def _interval(date: Column) -> Column:
    return F.floor(F.datediff(date, F.lit(EPOCH).cast("date")) / F.lit(INTERVAL_DAYS)).cast("int")


def _interval_date(idx: Column, offset: int) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), idx * F.lit(INTERVAL_DAYS) + F.lit(offset))


def clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Closed boxes; neighbours share an edge, so the first match decides there."""
    k = F.col("r_regionkey").cast("double")
    return table(spark, folder, "region").select(
        F.col("r_name").alias("cluster"),
        F.col("r_regionkey").alias("cluster_idx"),
        (k * 2).alias("lat0"),
        (k * 2 + 2).alias("lat1"),
        F.lit(6.0).alias("lon0"),
        F.lit(9.0).alias("lon1"),
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("cluster_idx"))
    supplier = (
        table(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("ordinal"),
            "cluster_idx",
            (F.greatest(F.lit(0.0), F.col("s_acctbal")) / F.lit(10.0)).alias("elevation"),
        )
    )
    placed = sample_sites(supplier, clusters(spark, folder), "cluster_idx")
    station = F.get(F.array(*[F.lit(s) for s in STATIONS]), F.col("cluster_idx"))
    return placed.select(
        F.col("ordinal").alias("site_id"), "site_name", "cluster", "cluster_idx",
        "latitude", "longitude", "elevation", station.alias("station"),
    )


def daily_weather(spark: SparkSession, folder: str) -> DataFrame:
    """(site, day) rows with gaps between days and some missing radiation readings."""
    price, tax, disc = F.max("l_extendedprice"), F.max(_pct("l_tax")), F.max(_pct("l_discount"))
    tmax = F.lit(20.0) + F.lit(1.5) * F.floor(price / F.lit(9000))
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("site_id"), _day("l_shipdate").alias("date"))
        .agg(
            tmax.alias("tmax"),
            (tmax - F.lit(6.0) - F.lit(1.5) * disc).alias("tmin"),
            (F.floor(F.greatest(F.lit(0.0), F.sum("l_quantity") - F.lit(15.0)) / F.lit(2)) / F.lit(2.0)).alias("rain"),
            (F.lit(3.0) + F.lit(0.5) * tax).alias("et0"),
            (F.lit(60.0) + F.lit(4.0) * tax).alias("rh"),
            F.when(price >= F.lit(2500), F.lit(0.5) * F.floor(price / F.lit(2000))).alias("radiation"),
        )
    )


def _interval_means(rows: DataFrame, date: Column, keys: list[Column]) -> DataFrame:
    return rows.groupBy(*keys, _interval(date).alias("interval_idx")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_pct("l_discount")).alias("disc"), F.sum(_pct("l_tax")).alias("tax")
    )


def optical_obs(spark: SparkSession, folder: str) -> DataFrame:
    """One observation per 30-day interval; a single-row interval has no usable greenness."""
    means = _interval_means(table(spark, folder, "lineitem"), _day("l_shipdate"), [F.col("l_suppkey").alias("site_id")])
    greenness = F.when(F.col("n") >= 2, F.col("disc") * F.lit(0.08) / F.col("n"))
    return means.select(
        "site_id",
        _interval_date(F.col("interval_idx"), OPTICAL_OFFSET).alias("sensing_date"),
        greenness.alias("ndvi"),
        (F.col("tax") * F.lit(0.064) / F.col("n") - F.lit(0.2)).alias("ndwi"),
        (greenness * F.lit(1.1)).alias("evi"),
    )


def radar_obs(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    means = _interval_means(rows, _day("o_orderdate"), [F.col("l_suppkey").alias("site_id")])
    vv = F.col("tax") / (F.col("n") * F.lit(100.0))
    vh = F.col("disc") / (F.col("n") * F.lit(200.0))
    return means.select(
        "site_id",
        _interval_date(F.col("interval_idx"), RADAR_OFFSET).alias("sensing_date"),
        vv.alias("vv"),
        vh.alias("vh"),
        rvi(vv, vh).alias("rvi"),
    )


def band_obs(spark: SparkSession, folder: str) -> DataFrame:
    """Ten reflectance means per interval, spread between the two interval averages."""
    from cropspark.constants import BAND_KEYS

    means = _interval_means(table(spark, folder, "lineitem"), _day("l_shipdate"), [F.col("l_suppkey").alias("site_id")])
    total = F.col("n") * F.lit(1000.0)
    return means.select(
        "site_id",
        _interval_date(F.col("interval_idx"), OPTICAL_OFFSET).alias("sensing_date"),
        *[((F.col("disc") * F.lit(i + 1) + F.col("tax")) / total).alias(k) for i, k in enumerate(BAND_KEYS)],
    )


def hourly_weather(spark: SparkSession, folder: str) -> DataFrame:
    """First reading of each hour per station."""
    first = F.min_by("value", "event_id")
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("site_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg((F.lit(5.0) + first % F.lit(25.0)).alias("temp"), (F.lit(80.0) + F.floor(first) % F.lit(21)).cast("double").alias("rh"))
    )


def farmer_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"))


def farms(spark: SparkSession, folder: str) -> DataFrame:
    """Farm rows; the undated and the unparsable sizes come from two order priorities."""
    priority = F.col("o_orderpriority")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("farmer_profile_id"),
        F.when(priority == "5-LOW", F.lit("unknown"))
        .otherwise(F.concat(F.floor(F.col("o_totalprice") / 100000).cast("string"), F.lit(".5 ha")))
        .alias("farm_size"),
        F.col("o_orderstatus").alias("state"),
        F.when(priority != "4-NOT SPECIFIED", F.col("o_orderdate")).alias("created_at"),
    )


def farm_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Weather site of each farm: the lowest supplier among its lines."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("farm_id"))
        .agg(F.min("l_suppkey").alias("site_id"))
    )


def farm_crops(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("farm_id"), F.col("l_partkey").alias("crop_id")
    )


def crops(spark: SparkSession, folder: str) -> DataFrame:
    name = F.lit(None).cast("string")
    for kind, crop in CROP_BY_TYPE.items():
        name = F.when(F.col("p_type") == kind, F.lit(crop)).otherwise(name)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), name.alias("name"))


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """Survey rows of the customers with a non-negative balance; the others have none."""
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    return (
        table(spark, folder, "customer")
        .filter(bal >= 0)
        .select(
            F.col("c_custkey").alias("farmer_id"),
            F.when(seg == "BUILDING", F.lit(0.0)).when(seg != "MACHINERY", bal / F.lit(2500.0)).alias("yield_value"),
            F.when(seg != "HOUSEHOLD", seg.isin("BUILDING", "FURNITURE")).alias("has_extension_access"),
            (bal > 5000).alias("used_fertilizer"),
            F.when(seg != "AUTOMOBILE", bal > 2000).alias("received_credit"),
            F.when(seg != "FURNITURE", bal / F.lit(100.0)).alias("asset_score"),
            (F.col("c_nationkey") * F.lit(4.0)).alias("market_access_score"),
            F.col("c_mktsegment").alias("head_gender"),
        )
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    score = F.floor(F.col("o_totalprice") / F.lit(5000)).cast("double")
    severity = F.when(score >= 65, "CRITICAL").when(score >= 35, "ELEVATED").when(score >= 15, "WATCH").otherwise("NORMAL")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("field_id"),
        F.col("o_orderdate").alias("predicted_at"),
        F.col("o_orderpriority").alias("model_version"),
        score.alias("risk_score"),
        severity.alias("severity"),
    )


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """First lines are linked to their order's prediction, the others only name the field."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    return (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("prediction_id"),
            F.col("o_custkey").alias("field_id"),
            F.col("l_shipdate").alias("observed_at"),
            F.when(flag == "A", "agent_visit").when(flag == "N", "diagnosis").otherwise("harvest").alias("outcome_type"),
            (F.col("l_linestatus") == "F").alias("stress_confirmed"),
            F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("yield_t_ha"),
        )
    )
