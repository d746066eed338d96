"""Training-set build: usable sites, per-observation features, labels one interval ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.constants import (
    FEATURES,
    MAX_LABEL_GAP_DAYS,
    MIN_OBSERVATIONS,
    PEER_RELATIVE,
    WEATHER_VARS,
    WINDOW_DAYS,
)
from cropspark.functions.labels import stress_class
from cropspark.functions.numeric import half_even
from cropspark.operators.calendar import site_series
from cropspark.operators.canopy import canopy_features, observation_history, with_radar
from cropspark.operators.peers import cohort_z, peer_stats, value_cohorts, with_peer_z
from cropspark.operators.weather import cut_windows, weather_features, window_totals
from cropspark.session import cut_lineage


def site_coverage(daily: DataFrame) -> DataFrame:
    """First and last day of every site that observed all six variables at least once."""
    counts = daily.groupBy("site_id").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        *[F.count(v).alias(f"n_{v}") for v in WEATHER_VARS],
    )
    complete = F.lit(True)
    for v in WEATHER_VARS:
        complete = complete & (F.col(f"n_{v}") > 0)
    return counts.filter(complete).select("site_id", "start_date", "end_date")


def usable_observations(daily: DataFrame, optical: DataFrame, sites: DataFrame) -> DataFrame:
    """Observation histories of the sites with complete weather and at least six observations."""
    place = sites.select("site_id", "cluster", "latitude", "longitude", "elevation")
    return (
        observation_history(optical)
        .filter(F.col("n_obs") >= MIN_OBSERVATIONS)
        .hint("merge")  # both lie by site already
        .join(site_coverage(daily), "site_id")
        .join(place, "site_id")
    )


def label_observations(obs: DataFrame, n_clusters: int) -> DataFrame:
    """Attach the peer anomaly of the next observation, when it lies within the label horizon."""
    cohorts = value_cohorts(obs, n_clusters).select(
        F.col("cluster").alias("_c"),
        F.col("sensing_date").alias("_d"),
        F.col("ndvi").alias("_v"),
        cohort_z(F.col("ndvi"), F.col("n_peers"), F.col("peer_mean"), F.col("peer_sd")).alias("z"),
    )
    known = cohorts.filter(F.col("z").isNotNull())
    ready = obs.filter(
        F.col("ndvi").isNotNull() & (F.datediff("next_date", "sensing_date") <= F.lit(MAX_LABEL_GAP_DAYS))
    )
    joined = ready.hint("merge").join(  # both sides grow with the rows, however small their files
        known,
        (F.col("cluster") == F.col("_c")) & (F.col("next_date") == F.col("_d")) & (F.col("next_ndvi") == F.col("_v")),
    )
    return joined.select(
        *obs.columns,
        half_even(F.col("z"), 4).alias("forward_z"),
        stress_class(F.col("z")).alias("label"),
    )


def canopy_samples(
    daily: DataFrame,
    optical: DataFrame,
    radar: DataFrame,
    sites: DataFrame,
    n_clusters: int,
    materialise: bool = True,
) -> DataFrame:
    """Labelled observations with a full look-back and their canopy state, before any weather window.

    The usable observations feed the cohort totals, the own-value groups and the labelled rows; they are
    written once so that the raw tables behind them are scanned once.
    """
    usable = usable_observations(daily, optical, sites)
    if materialise:
        usable = cut_lineage(usable)
    labelled = label_observations(usable, n_clusters)
    in_reach = (F.datediff("sensing_date", "start_date") >= F.lit(WINDOW_DAYS)) & (
        F.col("sensing_date") <= F.col("end_date")
    )
    paired = with_radar(labelled.filter(in_reach).drop("start_date", "end_date"), radar)
    return paired.select(
        "site_id",
        "cluster",
        F.col("sensing_date").alias("obs_date"),
        F.col("next_date").alias("label_date"),
        "label",
        "forward_z",
        "latitude",
        "longitude",
        "elevation",
        *canopy_features(),
    )


def build_samples(
    daily: DataFrame,
    optical: DataFrame,
    radar: DataFrame,
    sites: DataFrame,
    n_clusters: int,
    materialise: bool = True,
) -> DataFrame:
    """One row per labelled observation: the 29 features, label, forward_z and keys.

    The peer reference needs the whole sample set, so it is taken from the canopy rows (one per site
    and interval) before the weather windows are cut; the long daily series is read once. The canopy
    rows are written once and read by both passes unless ``materialise`` is switched off.
    """
    canopy = canopy_samples(daily, optical, radar, sites, n_clusters, materialise)
    if materialise:
        canopy = cut_lineage(canopy)
    asofs = with_peer_z(canopy, peer_stats(canopy), n_clusters)
    totals = window_totals(cut_windows(site_series(daily), asofs, "obs_date"))
    keys = ["label", "forward_z", "site_id", "cluster", "obs_date", "label_date"]
    ready = totals.select(*keys, *_canopy_columns(), *weather_features())
    return ready.select(*FEATURES, *keys)


def _canopy_columns() -> list[str]:
    z = [f"{c}_z_peer" for c in PEER_RELATIVE]
    return ["ndvi", "ndmi", "evi", "vci", "rvi", "vh_vv_ratio", "latitude", "longitude", "elevation", *z]
