"""Calendars, windows, cohorts and joins over the site tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions.labels import stress_class
from cropspark.functions.numeric import finite
from cropspark.operators import calendar, canopy, lookup, peers, weather
from cropspark.plans import models as MO
from cropspark.plans import training as TP
from cropspark.plans.evaluation import site_climatology
from cropspark.queries import oracle as O
from cropspark.queries.flatten import plain
from cropspark.queries.oracle import rounded
from cropspark.session import cut_lineage


def _asofs(d):
    return d.canopy.select("site_id", "obs_date")


def _windows(d):
    return weather.cut_windows(calendar.site_series(d.daily_weather), _asofs(d), "obs_date")


def _without_radar(d):
    """The 35 model columns of the radar ablation, from the stored samples with their twins."""
    return MO.model_frame(d.stored_samples, d.n_clusters).select("site_id", "obs_date", *MO.variant_features(no_radar=True))


def _coverage_rows(d):
    return cut_lineage(TP.usable_observations(d.daily_weather, d.optical_obs, d.sites))


def _unequal_weather(d):
    """Daily weather in which some sites never report radiation."""
    low = d.sites.select("site_id", (F.col("elevation") > 900).alias("no_sensor"))
    return d.daily_weather.join(low, "site_id").withColumn("radiation", F.when(~F.col("no_sensor"), F.col("radiation"))).drop("no_sensor")


_MU_SIGMA = ", ".join(f"avg({c}) AS {c}_mu, stddev_samp({c}) AS {c}_sigma" for c in K.CLUSTER_RELATIVE)
_MU_SIGMA_COLS = [f"{c}_{s}" for c in K.CLUSTER_RELATIVE for s in ("mu", "sigma")]
_TWIN_LIST = [O.ref_z(f"s.{c}", f"r.{c}_mu", f"r.{c}_sigma") + f" AS {c}_cz" for c in K.CLUSTER_RELATIVE]
_TWINS = ", ".join(_TWIN_LIST)
_NO_RADAR = MO.variant_features(no_radar=True)

QUERIES = {
    "win05_gap_filled_calendar": (
        lambda d: plain(calendar.dense_days(calendar.fill_gaps(d.daily_weather))),
        rounded("SELECT site_id, CAST(date AS VARCHAR) AS date, tmax, tmin, rain, et0, rh, radiation FROM dense",
                "tmax", "tmin", "rain", "et0", "rh", "radiation"),
    ),
    "flt02_complete_sites": (
        lambda d: calendar.complete_sites(_unequal_weather(d)),
        rounded("""SELECT d.site_id FROM daily d JOIN sites s ON s.site_id = d.site_id GROUP BY 1
                   HAVING count(tmax) > 0 AND count(CASE WHEN elevation <= 900 THEN radiation END) > 0"""),
    ),
    "flt03_usable_sites": (
        lambda d: _coverage_rows(d).groupBy("site_id", "cluster").agg(F.count(F.lit(1)).alias("n")),
        rounded("SELECT site_id, cluster, count(*) AS n FROM usable GROUP BY 1, 2"),
    ),
    "win01_flt04_next_observation": (
        lambda d: plain(canopy.observation_history(d.optical_obs)
                        .filter(F.datediff("next_date", "sensing_date") <= K.MAX_LABEL_GAP_DAYS)
                        .select("site_id", "sensing_date", "next_date", "next_ndvi")),
        rounded("""SELECT site_id, CAST(sensing_date AS VARCHAR) AS sensing_date, CAST(next_date AS VARCHAR) AS next_date, next_ndvi
                   FROM history WHERE next_date - sensing_date <= 45""", "next_ndvi"),
    ),
    "win02_fn07_condition_against_earlier_range": (
        lambda d: plain(canopy.observation_history(d.optical_obs).filter(finite(F.col("ndvi"))).select(
            "site_id", "sensing_date", "past_min", "past_max",
            canopy.condition(F.col("ndvi"), F.col("past_min"), F.col("past_max")).alias("vci"))),
        rounded(f"""SELECT site_id, CAST(sensing_date AS VARCHAR) AS sensing_date, past_min, past_max,
                    {O.vci('ndvi', 'coalesce(past_min, ndvi)', 'coalesce(past_max, ndvi)')} AS vci
                    FROM history WHERE ndvi IS NOT NULL""", "past_min", "past_max", "vci"),
    ),
    "win03_site_climatology": (
        lambda d: plain(site_climatology(d.canopy_z).select("site_id", "obs_date", "ndvi_z_peer", "clim_z_prior")),
        rounded("SELECT site_id, CAST(obs_date AS VARCHAR) AS obs_date, ndvi_z_peer, clim_z_prior FROM canopy_clim", "ndvi_z_peer", "clim_z_prior"),
    ),
    "win04_agg01_trailing_sums": (
        lambda d: plain(weather.window_totals(_windows(d)).select(
            "site_id", "obs_date", "heat_sum_90", "tmax_sum_30", "tmin_sum_30", "rain_sum_30", "rain_sum_90", "et0_sum_90", "rh_sum_30", "radiation_sum_90")),
        rounded("""SELECT site_id, CAST(ref_day AS VARCHAR) AS obs_date, heat_sum_90, tmax_sum_30, tmin_sum_30, rain_sum_30, rain_sum_90, et0_sum_90,
                   rh_sum_30, radiation_sum_90 FROM train_totals""",
                "heat_sum_90", "tmax_sum_30", "tmin_sum_30", "rain_sum_30", "rain_sum_90", "et0_sum_90", "rh_sum_30", "radiation_sum_90"),
    ),
    "win06_longest_dry_spell": (
        lambda d: plain(weather.window_totals(_windows(d)).select("site_id", "obs_date", "dry_run_30", "dry_run_90")),
        rounded("SELECT site_id, CAST(ref_day AS VARCHAR) AS obs_date, dry_run_30, dry_run_90 FROM train_totals"),
    ),
    "win07_win08_season_onset_heat": (
        lambda d: plain(weather.window_totals(_windows(d)).select("site_id", "obs_date", "days_since_onset", "heat_since_onset")),
        rounded("SELECT site_id, CAST(ref_day AS VARCHAR) AS obs_date, days_since_onset, heat_since_onset FROM train_totals", "heat_since_onset"),
    ),
    "win12_join13_rain_climatology": (
        lambda d: plain(_windows(d).select("site_id", "obs_date", "clim_rain")),
        rounded("""SELECT t.site_id, CAST(t.ref_day AS VARCHAR) AS obs_date, c.clim AS clim_rain FROM asof_train t
                   LEFT JOIN train_clim c ON c.site_id = t.site_id AND c.ref_day = t.ref_day""", "clim_rain"),
    ),
    "join05_nearest_radar": (
        lambda d: plain(canopy.with_radar(d.optical_obs, d.radar_obs).select("site_id", "sensing_date", "radar_date", "rvi", "vh_vv_ratio")),
        rounded("""SELECT o.site_id, CAST(o.sensing_date AS VARCHAR) AS sensing_date, CAST(r.radar_date AS VARCHAR) AS radar_date, r.rvi,
                   CASE WHEN r.vv <> 0 THEN r.vh / r.vv END AS vh_vv_ratio
                   FROM optical o LEFT JOIN radar_near r ON r.site_id = o.site_id AND r.sensing_date = o.sensing_date""", "rvi", "vh_vv_ratio"),
    ),
    "join06_date_alignment": (
        lambda d: plain(_aligned(d)),
        rounded("""SELECT o.site_id, CAST(o.sensing_date AS VARCHAR) AS sensing_date, w.idx, w.rain FROM optical o
                   JOIN dense w ON w.site_id = o.site_id AND w.date = o.sensing_date""", "rain"),
    ),
    "join07_agg07_flt06_cohort_without_own_value": (
        lambda d: plain(TP.label_observations(_coverage_rows(d), d.n_clusters).select("site_id", "sensing_date", "next_date", "forward_z", "label")),
        rounded("SELECT site_id, CAST(sensing_date AS VARCHAR) AS sensing_date, CAST(next_date AS VARCHAR) AS next_date, forward_z, label FROM labelled", "forward_z"),
    ),
    "prj06_label_classes": (
        lambda d: plain(d.canopy_z.groupBy("cluster", stress_class(F.col("ndvi_z_peer")).alias("label")).agg(
            F.count(F.lit(1)).alias("n"), F.min("ndvi_z_peer").alias("lowest"))),
        rounded(f"SELECT cluster, {O.stress('ndvi_z_peer')} AS label, count(*) AS n, min(ndvi_z_peer) AS lowest FROM canopy_z GROUP BY 1, 2", "lowest"),
    ),
    "agg04_peer_reference": (
        lambda d: plain(peers.peer_stats(d.canopy), 10),
        rounded("SELECT cluster, CAST(m AS INTEGER) AS month, ndvi_mu, ndvi_sigma, rvi_mu, rvi_sigma FROM peer_ref",
                "ndvi_mu", "ndvi_sigma", "rvi_mu", "rvi_sigma", digits=10),
    ),
    "join08_fn06_peer_z_lookup": (
        lambda d: plain(_peer_lookup(d)),
        rounded(f"""SELECT o.site_id, CAST(o.sensing_date AS VARCHAR) AS sensing_date,
                    {O.ref_z('o.ndvi', 'p.ndvi_mu', 'p.ndvi_sigma')} AS ndvi_z_peer
                    FROM optical o JOIN zoned z ON z.site_id = o.site_id
                    LEFT JOIN peer_ref p ON p.cluster = z.zone AND p.m = month(o.sensing_date) AND p.m <> 2""", "ndvi_z_peer"),
    ),
    "agg05_cluster_reference": (
        lambda d: plain(peers.cluster_stats(d.samples)),
        rounded(f"SELECT cluster, {_MU_SIGMA} FROM samples GROUP BY 1", *_MU_SIGMA_COLS),
    ),
    "agg06_win10_join09_prj04_twins": (
        lambda d: plain(peers.with_twins(d.stored_samples, peers.cluster_stats(d.stored_samples), d.n_clusters).select(
            "site_id", "obs_date", *K.MODEL_FEATURES), 5),
        rounded(f"""SELECT s.site_id, CAST(s.obs_date AS VARCHAR) AS obs_date, {', '.join('s.' + c for c in K.MODEL_FEATURES if not c.endswith('_cz'))}, {_TWINS}
                    FROM samples s LEFT JOIN (SELECT cluster, {_MU_SIGMA} FROM samples GROUP BY 1) r ON r.cluster = s.cluster""",
                *[c for c in K.MODEL_FEATURES if c not in ("heat_stress_days", "dry_spell_30", "dry_spell_90", "days_since_onset")], digits=5),
    ),
    "prj05_radar_ablation": (
        lambda d: plain(_without_radar(d), 5),
        rounded(f"""SELECT s.site_id, CAST(s.obs_date AS VARCHAR) AS obs_date, {', '.join('s.' + c for c in _NO_RADAR if not c.endswith('_cz'))},
                           {', '.join(t for t in _TWIN_LIST if t.rsplit(' AS ', 1)[1] in _NO_RADAR)}
                    FROM samples s LEFT JOIN (SELECT cluster, {_MU_SIGMA} FROM samples GROUP BY 1) r ON r.cluster = s.cluster""",
                *[c for c in _NO_RADAR if c not in ("heat_stress_days", "dry_spell_30", "dry_spell_90", "days_since_onset")], digits=5),
    ),
    "join10_point_in_box": (
        lambda d: plain(lookup.assign_zone(_shifted_sites(d), d.clusters, out="zone")),
        rounded("""SELECT p.site_id, p.latitude, p.longitude, min_by(c.cluster, c.cluster_idx) AS zone FROM (
                     SELECT site_id, round_even(latitude, 0) AS latitude, longitude + CASE WHEN cluster = 'ASIA' THEN 1e0 ELSE 0e0 END AS longitude FROM sites) p
                   LEFT JOIN clusters c ON p.latitude BETWEEN c.lat0 AND c.lat1 AND p.longitude BETWEEN c.lon0 AND c.lon1 GROUP BY 1, 2, 3""", "latitude", "longitude"),
    ),
    "join10_point_in_box_by_cell": (
        lambda d: plain(lookup.assign_zone(_shifted_sites(d), d.clusters, "latitude", "longitude", "zone")),
        rounded("""SELECT p.site_id, p.latitude, p.longitude, min_by(c.cluster, c.cluster_idx) AS zone FROM (
                     SELECT site_id, round_even(latitude, 0) AS latitude, longitude + CASE WHEN cluster = 'ASIA' THEN 1e0 ELSE 0e0 END AS longitude FROM sites) p
                   LEFT JOIN clusters c ON p.latitude BETWEEN c.lat0 AND c.lat1 AND p.longitude BETWEEN c.lon0 AND c.lon1 GROUP BY 1, 2, 3""", "latitude", "longitude"),
    ),
    "agg09_leaf_wetness": (
        lambda d: plain(weather.leaf_wetness(d.hourly_weather)),
        rounded("SELECT site_id, CAST(day AS VARCHAR) AS day, wet_hours, wet_temp FROM wet_days", "wet_temp"),
    ),
    "agg10_fn15_severity_totals": (
        lambda d: plain(weather.severity_totals(d.hourly_weather, d.last_hourly_day)),
        rounded("SELECT station AS site_id, dsv_total, CAST(dsv_total >= 18 AS INTEGER) AS spray_due FROM dsv_totals"),
    ),
    "agg08_own_baseline": (
        lambda d: plain(canopy.own_baseline(d.optical_obs.dropna())),
        rounded("""SELECT site_id, CAST(max(sensing_date) AS VARCHAR) AS latest_sensing_date, arg_max(ndvi, sensing_date) AS latest_ndvi,
                   arg_max(ndwi, sensing_date) AS latest_ndwi, arg_max(evi, sensing_date) AS latest_evi, count(*) AS observations,
                   min(ndvi) AS ndvi_min, max(ndvi) AS ndvi_max, avg(ndvi) AS ndvi_mean, stddev_pop(ndvi) AS ndvi_std
                   FROM optical WHERE ndvi IS NOT NULL AND evi IS NOT NULL GROUP BY 1""",
                "latest_ndvi", "latest_ndwi", "latest_evi", "ndvi_min", "ndvi_max", "ndvi_mean", "ndvi_std"),
    ),
    "agg11_noisy_or_aggregate": (
        lambda d: plain(_noisy_or(d)),
        rounded("""SELECT l_suppkey AS site_id, 1e0 - product(1e0 - least(1e0, l_discount / 10e0)) AS combined FROM lineitem GROUP BY 1""", "combined"),
    ),
    "agg13_monthly_means": (
        lambda d: plain(_monthly(d)),
        rounded("""SELECT site_id, CAST(date_trunc('month', date) AS DATE)::VARCHAR AS month, avg((tmax + tmin) / 2e0) AS temp, avg(rain) AS rain
                   FROM dense GROUP BY 1, 2""", "temp", "rain"),
    ),
}


def _aligned(d):
    days = calendar.dense_days(calendar.fill_gaps(d.daily_weather))
    start = TP.site_coverage(d.daily_weather).select("site_id", "start_date")
    return (
        d.optical_obs.select("site_id", "sensing_date")
        .join(days.select("site_id", F.col("date").alias("sensing_date"), "rain"), ["site_id", "sensing_date"])
        .join(start, "site_id")
        .select("site_id", "sensing_date", F.datediff("sensing_date", "start_date").cast("long").alias("idx"), "rain")
    )


def _peer_lookup(d):
    """Observations against the reference; February was never measured and must stay NULL."""
    stats = peers.peer_stats(d.canopy).filter(F.col("month") != 2)
    placed = lookup.assign_zone(d.sites.select("site_id", "latitude", "longitude"), d.clusters)
    obs = d.optical_obs.join(placed.select("site_id", "cluster"), "site_id").withColumn("rvi", F.lit(None).cast("double"))
    return peers.with_peer_z(obs, stats, d.n_clusters, "sensing_date").select("site_id", "sensing_date", "ndvi_z_peer")


def _shifted_sites(d):
    """Sites moved onto the shared box edges, one zone pushed partly out of every box."""
    return d.sites.select(
        "site_id", F.bround("latitude", 0).alias("latitude"),
        (F.col("longitude") + F.when(F.col("cluster") == "ASIA", 1.0).otherwise(0.0)).alias("longitude"),
    )


def _noisy_or(d):
    from cropspark.functions.numeric import noisy_or_agg

    return d.raw("lineitem").groupBy(F.col("l_suppkey").alias("site_id")).agg(noisy_or_agg(F.col("l_discount") / 10).alias("combined"))


def _monthly(d):
    from cropspark.plans.embeddings import monthly_weather

    return monthly_weather(calendar.fill_gaps(d.daily_weather))
