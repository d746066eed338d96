"""End-to-end jobs: training samples, field features, scoring, farmer view, crop health."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import farmer as FR
from cropspark.operators import calendar
from cropspark.plans import crop_health as CH
from cropspark.plans import embeddings as EM
from cropspark.plans import farmers as FA
from cropspark.plans import features as FE
from cropspark.plans import nightly
from cropspark.plans import scoring as SC
from cropspark.queries import oracle as O
from cropspark.queries.flatten import plain
from cropspark.queries.oracle import rounded
from cropspark.sources import store
from cropspark.streaming.runs import scratch

NIGHT = dt.datetime(2001, 7, 30, 12, 0)
_INT = ("heat_stress_days", "dry_spell_30", "dry_spell_90", "days_since_onset")
_DOUBLE_FEATURES = [c for c in K.FEATURES if c not in _INT]


def _flag(c):
    return f"CAST({c} AS INTEGER) AS {c}"


_FARMER_SQL = f"""SELECT user_id, farm_id, farm_size, state, CAST(created_at AS VARCHAR) AS created_at, site_id, latitude, longitude,
  array_to_string(crops, '|') AS crops, yield_value, {_flag('has_extension_access')}, {_flag('used_fertilizer')}, {_flag('received_credit')},
  asset_score, market_access_score, crop_diversity_score FROM farmers"""

_GAP = "CASE g " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.GAP_WORDING.items()) + " END"


def _whole(x):
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


_DRIVERS = f"""list_filter([
  CASE WHEN drought > 0.2e0 THEN 'Water satisfaction ' || {_whole('water_satisfaction_30 * 100e0')} || '% over 30 days (' || {_whole('water_deficit_30')} || ' mm unmet demand)' END,
  CASE WHEN dry_spell_30 >= 8 THEN 'Longest dry spell ' || dry_spell_30 || ' days in the last 30' END,
  CASE WHEN spray_due THEN 'Blight severity values at ' || dsv_total || ', spray threshold (18) reached'
       WHEN dsv_total >= 9 THEN 'Blight severity values accumulating (' || dsv_total || '/18)' END,
  CASE WHEN heat_stress_days <> 0 THEN heat_stress_days || ' days above 35 °C during flowering' END,
  CASE WHEN vegetation > 0.35e0 THEN 'Model projects canopy stress relative to peers within 30 days (hazard ' || format('{{:.2f}}', round_even(vegetation, 2)) || ')' END,
  CASE WHEN round_even(health_raw, 1) < 45 THEN 'Crop Health Index ' || {_whole('round_even(health_raw, 1)')} || '/100 — ' || ({O.health_status('health_raw')}) END,
  CASE WHEN rain_anomaly_30 < -20 THEN 'Rainfall ' || {_whole('abs(rain_anomaly_30)')} || ' mm below the site''s normal for this time of year' END
 ], lambda s: s IS NOT NULL) || list_transform(gaps[1:2], lambda g: {_GAP})"""

_ACTION = f"""CASE WHEN spray_due THEN '{K.ACTION_SPRAY}'
  WHEN dominant = 'drought' AND drought > 0.4e0 THEN replace(replace('{K.ACTION_DROUGHT}', '{{crop}}', crop), '{{stage}}', stage)
  WHEN dominant = 'heat' THEN '{K.ACTION_HEAT}'
  WHEN dominant = 'disease' THEN replace(replace('{K.ACTION_DISEASE}', '{{crop}}', crop), '{{stage}}', stage)
  WHEN dominant = 'vegetation' THEN '{K.ACTION_VEGETATION}'
  WHEN severity IN ('ELEVATED', 'WATCH') THEN '{K.ACTION_MONITOR}' ELSE '{K.ACTION_DEFAULT}' END"""

_H = O.clamp("vegetation_raw")
_CLASS = "CASE severity WHEN 'CRITICAL' THEN 2 WHEN 'ELEVATED' THEN 1 ELSE 0 END"


def _results(d):
    return SC.result_rows(d.assessed)


def _reports(d):
    from cropspark.plans.training import site_coverage

    asofs = site_coverage(d.daily_weather).select("site_id", F.col("end_date").alias("asof"))
    return CH.crop_health_report(d.sites, FE.recent_history(d.optical_obs, asofs))


def _coldstart(d):
    """Every site's coordinates without any survey; half of the crops and sizes are left out."""
    coords = d.sites.select(
        "site_id", "latitude", "longitude", F.lit(None).cast("string").alias("state"),
        F.when(F.col("cluster").isin("ASIA", "EUROPE"), F.lit("Rice")).alias("crop_type"),
        F.when(F.col("cluster") != "ASIA", F.lit(2.0)).alias("farm_size"),
    )
    fields = SC.coldstart_fields(coords)
    rows = FE.field_features(fields, d.site_state)
    assessed = SC.assess(SC.hazard_anomaly(rows), SC.coldstart_survey(fields))
    return assessed.select("field_id", "crop", F.col("risk.*"), "value_at_risk", F.col("vulnerability.score").alias("v_score"), "stage")


def _source_choice(d):
    """Rows stored at the order times; fields whose latest one is fresh use it, the others are computed."""
    root = scratch(d.spark, "store")
    times = d.raw("orders").groupBy(F.col("o_custkey").alias("field_id")).agg(F.max("o_orderdate").cast("timestamp_ntz").alias("at"))
    store.append(FE.to_store_rows(d.field_rows.join(times, "field_id"), F.col("at")), root, "field_features")
    rows = nightly.stored_or_computed(d.fields, d.site_state, root, NIGHT)
    return plain(rows.select("field_id", "crop", "feature_source", F.col("context.dsv_total").alias("dsv_total"), F.col("features.ndvi").alias("ndvi")))


def _nightly(d):
    """One run on an empty store; the summary and what is stored agree."""
    root = scratch(d.spark, "store")
    summary = nightly.nightly(d.fields, d.site_state, root, NIGHT)
    stored = store.read(d.spark, root, "field_features").agg(F.count(F.lit(1)).alias("stored")).withColumn("one", F.lit(1))
    rejects = d.spark.read.parquet(f"{root}/rejects").agg(F.count(F.lit(1)).alias("rejects")).withColumn("one", F.lit(1))
    return summary.withColumn("one", F.lit(1)).join(stored, "one").join(rejects, "one").drop("one")


def _embedding_inputs(d):
    wanted = d.canopy.select("site_id", "obs_date")
    inputs = EM.build_inputs(wanted, d.sites, calendar.fill_gaps(d.stored_weather), d.stored_optical, d.stored_radar, d.band_obs)
    steps = F.inline(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda t: F.struct(
        t.alias("t"),
        *[F.get("x", t * F.lit(17) + F.lit(i)).cast("double").alias(f"x_{c}") for i, c in enumerate(K.CHANNELS)],
        F.aggregate(F.slice("mask", t * F.lit(17) + F.lit(1), F.lit(17)), F.lit(0.0), lambda a, m: a + m.cast("double")).alias("missing"),
    )))
    return inputs.select("site_id", "obs_date", "month", steps)


_MONTH = "CAST(date_trunc('month', {}) AS DATE)"
_BAND_AVG = ", ".join(f"avg({b}) AS {b}" for b in K.BAND_KEYS)


def _db(x):
    return f"CASE WHEN {x} > 0 THEN (10e0 * log10({x}) + 25e0) / 25e0 WHEN {x} IS NOT NULL THEN (-50e0 + 25e0) / 25e0 END"


CHANNEL_SQL = {
    "vv": _db("r.vv"), "vh": _db("r.vh"), **{b: f"b.{b}" for b in K.BAND_KEYS},
    "temp": "(w.temp + 1e0) / 35e0", "precip": "(w.rain / 1000e0) / 0.03e0", "ndvi": "o.ndvi",
}
_EMBED_SQL = f"""
SELECT k.site_id, CAST(k.obs_date AS VARCHAR) AS obs_date, CAST(month(k.obs_date) - 1 AS INTEGER) AS month, CAST(k.t AS INTEGER) AS t,
       {', '.join(f"coalesce(CAST(CAST({v} AS FLOAT) AS DOUBLE), 0e0) AS x_{c}" for c, v in CHANNEL_SQL.items())},
       CAST(CAST(s.elevation / 2000e0 AS FLOAT) AS DOUBLE) AS x_elevation, 0e0 AS x_slope,
       CAST({' + '.join(f"CASE WHEN ({v}) IS NULL THEN 1 ELSE 0 END" for v in CHANNEL_SQL.values())} AS DOUBLE) AS missing
FROM (SELECT site_id, obs_date, t, CAST(date_trunc('month', obs_date) - to_months(CAST(11 - t AS INTEGER)) AS DATE) AS m
      FROM canopy CROSS JOIN (SELECT unnest(range(0, 12)) AS t)) k
JOIN sites s ON s.site_id = k.site_id
LEFT JOIN (SELECT site_id, {_MONTH.format('date')} AS m, avg((tmax + tmin) / 2e0) AS temp, avg(rain) AS rain FROM dense GROUP BY 1, 2) w ON w.site_id = k.site_id AND w.m = k.m
LEFT JOIN (SELECT site_id, {_MONTH.format('sensing_date')} AS m, avg(ndvi) AS ndvi FROM optical GROUP BY 1, 2) o ON o.site_id = k.site_id AND o.m = k.m
LEFT JOIN (SELECT site_id, {_MONTH.format('sensing_date')} AS m, avg(vv) AS vv, avg(vh) AS vh FROM radar GROUP BY 1, 2) r ON r.site_id = k.site_id AND r.m = k.m
LEFT JOIN (SELECT site_id, {_MONTH.format('sensing_date')} AS m, {_BAND_AVG} FROM bands GROUP BY 1, 2) b ON b.site_id = k.site_id AND b.m = k.m"""

EMBED_FROM = _EMBED_SQL[_EMBED_SQL.index("FROM (SELECT site_id, obs_date, t") :]

QUERIES = {
    "job01_training_samples": (
        lambda d: plain(d.samples),
        rounded("SELECT * REPLACE (CAST(obs_date AS VARCHAR) AS obs_date, CAST(label_date AS VARCHAR) AS label_date) FROM samples",
                *_DOUBLE_FEATURES, "forward_z"),
    ),
    "job02_prj01_field_features": (
        lambda d: plain(d.field_rows.drop("crop_health").join(
            d.site_state.select("site_id", F.col("crop_health.score").alias("health")), "site_id")),
        rounded(f"""SELECT field_id, site_id, crop, CAST(ref_day AS VARCHAR) AS asof, cluster, {', '.join(K.FEATURES)}, index_source,
                    CAST(sensing_date AS VARCHAR) AS sensing_date, round_even(health_raw, 1) AS health, dsv_total, {_flag('spray_due')} FROM field_rows""",
                *_DOUBLE_FEATURES, "health"),
    ),
    "agg21_run_summary": (
        lambda d: plain(FE.run_summary(d.field_rows, FE.failed_fields(d.fields, d.site_state))),
        rounded("""SELECT count(*) AS fields, count(s.site_id) AS ok, count(*) FILTER (WHERE s.index_source <> 'sentinel-2') AS degraded,
                   count(*) FILTER (WHERE s.site_id IS NULL) AS failed, CAST(0 AS BIGINT) AS pruned,
                   round_even(count(*) FILTER (WHERE s.index_source <> 'sentinel-2') / count(s.site_id), 3) AS degraded_rate
                   FROM fields f LEFT JOIN site_state s ON s.site_id = f.site_id""", "degraded_rate"),
    ),
    "job03_risk_scoring": (
        lambda d: plain(d.assessed.select(
            "field_id", "crop", "stage", "model_version", "hazard", "vulnerability", "value_at_risk",
            F.col("risk.risk_score").alias("risk_score"), F.col("risk.expected_loss").alias("expected_loss"), F.col("risk.severity").alias("severity"))),
        rounded("""SELECT field_id, crop, stage, CASE WHEN index_source = 'sentinel-2' THEN 'persistence-v1' ELSE 'none' END AS model_version,
                   drought AS hazard_drought, disease AS hazard_disease, heat AS hazard_heat, vegetation AS hazard_vegetation,
                   combined AS hazard_combined, dominant AS hazard_dominant, v_score AS vulnerability_score, capacity AS vulnerability_coping_capacity,
                   array_to_string(gaps, '|') AS vulnerability_gaps, value_at_risk, risk_score, expected_loss, severity FROM ranked""",
                "hazard_drought", "hazard_disease", "hazard_heat", "hazard_vegetation", "hazard_combined", "vulnerability_score",
                "vulnerability_coping_capacity", "value_at_risk", "risk_score", "expected_loss"),
    ),
    "prj07_fn31_fn32_result_rows": (
        lambda d: plain(_results(d).select(
            "field_id", "model_version", "crop_type", "phenology_stage", "prediction", "priority_label", "risk_score_percent", "probabilities",
            "probabilities_of", "top_risk_factors", "inference", "spatiotemporal_indices", "microclimate_metrics", "recommended_action")),
        rounded(f"""SELECT field_id, CASE WHEN index_source = 'sentinel-2' THEN 'persistence-v1' ELSE 'none' END AS model_version, crop AS crop_type,
                    stage AS phenology_stage, CAST({_CLASS} AS INTEGER) AS prediction,
                    CASE {_CLASS} WHEN 2 THEN 'High Priority' WHEN 1 THEN 'Medium Priority' ELSE 'Low Priority' END AS priority_label,
                    risk_score AS risk_score_percent,
                    round_even(CASE WHEN vegetation_raw <= 0.5e0 THEN 1e0 - 2e0 * vegetation_raw ELSE 0e0 END, 3) AS probabilities_low,
                    round_even(CASE WHEN vegetation_raw <= 0.5e0 THEN 2e0 * vegetation_raw ELSE 2e0 - 2e0 * vegetation_raw END, 3) AS probabilities_medium,
                    round_even(CASE WHEN vegetation_raw <= 0.5e0 THEN 0e0 ELSE 2e0 * vegetation_raw - 1e0 END, 3) AS probabilities_high,
                    CASE WHEN index_source = 'sentinel-2' THEN '{K.PROBABILITIES_OF_ENCODED}' ELSE '{K.PROBABILITIES_OF}' END AS probabilities_of,
                    array_to_string(factors, '|') AS top_risk_factors,
                    severity AS inference_risk_level, dominant AS inference_dominant_hazard, combined AS inference_probability,
                    array_to_string(factors[1:4], '|') AS inference_primary_drivers,
                    CAST(index_source = 'sentinel-2' AS INTEGER) AS inference_model_contributed, cluster AS inference_cluster,
                    round_even(ndvi, 3) AS spatiotemporal_indices_ndvi, round_even(ndmi, 3) AS spatiotemporal_indices_ndwi,
                    round_even(evi, 3) AS spatiotemporal_indices_evi, round_even(vci, 1) AS spatiotemporal_indices_vci,
                    coalesce({O.health_status('health_raw').replace('CASE ', 'CASE WHEN health_raw IS NULL THEN NULL ', 1)}, 'Unavailable') AS spatiotemporal_indices_canopy_stress_status,
                    index_source AS spatiotemporal_indices_source, CAST(sensing_date AS VARCHAR) AS spatiotemporal_indices_sensing_date,
                    water_satisfaction_30 AS microclimate_metrics_water_satisfaction_30d, water_deficit_30 AS microclimate_metrics_water_deficit_30d_mm,
                    dry_spell_30 AS microclimate_metrics_longest_dry_spell_days, rain_anomaly_30 AS microclimate_metrics_rainfall_anomaly_30d_mm,
                    heat_stress_days AS microclimate_metrics_heat_stress_days, dsv_total AS microclimate_metrics_cumulative_dsv,
                    CAST(spray_due AS INTEGER) AS microclimate_metrics_spray_threshold_reached, gdd_since_onset AS microclimate_metrics_gdd_since_onset,
                    {_ACTION} AS recommended_action
                    FROM (SELECT *, CASE WHEN len({_DRIVERS}) > 0 THEN {_DRIVERS} ELSE ['{K.NO_DRIVERS}'] END AS factors FROM ranked)""",
                "risk_score_percent", "probabilities_low", "probabilities_medium", "probabilities_high", "inference_probability",
                "spatiotemporal_indices_ndvi", "spatiotemporal_indices_ndwi", "spatiotemporal_indices_evi", "spatiotemporal_indices_vci",
                "microclimate_metrics_water_satisfaction_30d", "microclimate_metrics_water_deficit_30d_mm",
                "microclimate_metrics_rainfall_anomaly_30d_mm", "microclimate_metrics_gdd_since_onset"),
    ),
    "prj09_log_summary": (
        lambda d: plain(SC.log_summary(_results(d)).drop("probabilities").groupBy("model_version", "feature_source", "risk_level", "dominant_hazard").agg(
            F.count(F.lit(1)).alias("n"), F.max("risk_score_percent").alias("worst"))),
        rounded("""SELECT CASE WHEN index_source = 'sentinel-2' THEN 'persistence-v1' ELSE 'none' END AS model_version, 'live' AS feature_source,
                   severity AS risk_level, dominant AS dominant_hazard, count(*) AS n, max(risk_score) AS worst FROM ranked GROUP BY ALL""", "worst"),
    ),
    "top03_triage_queue": (
        lambda d: plain(SC.triage_queue(d.assessed, 50)),
        rounded("SELECT field_id, expected_loss, severity FROM ranked ORDER BY expected_loss DESC, field_id LIMIT 50", "expected_loss"),
    ),
    "job04_fn09_crop_health_report": (
        lambda d: plain(_reports(d)),
        rounded(f"""SELECT s.site_id, CAST(c.site_id IS NOT NULL AS INTEGER) AS available,
                    CASE WHEN c.site_id IS NULL THEN '{CH.NO_HISTORY}' END AS reason, round_even(c.raw, 1) AS crop_health_score,
                    round_even(c.vigour, 3) AS crop_health_vigour, round_even(c.moisture, 3) AS crop_health_moisture, round_even(c.anomaly, 3) AS crop_health_anomaly,
                    CASE WHEN c.raw IS NOT NULL THEN {O.health_status('c.raw')} END AS crop_health_status,
                    round_even(c.ndvi, 3) AS observed_ndvi, round_even(c.ndwi, 3) AS observed_ndwi, round_even(c.evi, 3) AS observed_evi,
                    CAST(c.sensing_date AS VARCHAR) AS sensing_date, CASE WHEN c.site_id IS NOT NULL THEN 'self_history_12m' END AS baseline_kind,
                    c.observations AS baseline_observations, round_even(c.mean, 3) AS baseline_ndvi_mean, round_even(c.sd, 3) AS baseline_ndvi_std
                    FROM sites s LEFT JOIN (
                      SELECT *, {O.health('ndvi', 'ndwi', 'low', 'high', 'mean', 'sd')} AS raw, ({O.vci('ndvi', 'low', 'high')}) / 100e0 AS vigour,
                             {O.clamp('(ndwi + 0.2e0) / 0.6e0')} AS moisture,
                             1e0 / (1e0 + exp(-(CASE WHEN sd <= 1e-6 THEN 0e0 ELSE (ndvi - mean) / sd END))) AS anomaly
                      FROM (SELECT o.site_id, max(sensing_date) AS sensing_date, arg_max(ndvi, sensing_date) AS ndvi, arg_max(ndwi, sensing_date) AS ndwi,
                                   arg_max(evi, sensing_date) AS evi, count(*) AS observations, min(ndvi) AS low, max(ndvi) AS high, avg(ndvi) AS mean,
                                   stddev_pop(ndvi) AS sd
                            FROM optical o JOIN coverage k ON k.site_id = o.site_id
                            WHERE ndvi IS NOT NULL AND ndwi IS NOT NULL AND evi IS NOT NULL AND k.end_date - sensing_date BETWEEN 0 AND 365 GROUP BY 1)) c ON c.site_id = s.site_id""",
                "crop_health_score", "crop_health_vigour", "crop_health_moisture", "crop_health_anomaly", "observed_ndvi", "observed_ndwi",
                "observed_evi", "baseline_ndvi_mean", "baseline_ndvi_std"),
    ),
    "job05_src07_farmer_features": (
        lambda d: plain(d.farmers),
        rounded(_FARMER_SQL, "latitude", "longitude", "yield_value", "asset_score", "market_access_score"),
    ),
    "join01_latest_farm": (
        lambda d: plain(FA.latest_farm(d.farms)),
        rounded("""SELECT farmer_profile_id, id, farm_size, state, CAST(created_at AS VARCHAR) AS created_at FROM farms
                   QUALIFY row_number() OVER (PARTITION BY farmer_profile_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1"""),
    ),
    "join02_survey_left_join": (
        lambda d: plain(d.farmer_profiles.join(d.survey.withColumnRenamed("farmer_id", "user_id"), "user_id", "left").groupBy("has_extension_access").agg(
            F.count(F.lit(1)).alias("n"), F.count("asset_score").alias("n_assets"), F.avg("market_access_score").alias("market"))),
        rounded(f"""SELECT {_flag('has_extension_access')}, count(*) AS n, count(asset_score) AS n_assets, avg(market_access_score) AS market
                    FROM customer LEFT JOIN survey ON farmer_id = c_custkey GROUP BY 1""", "market"),
    ),
    "join03_agg02_crops_per_farm": (
        lambda d: plain(FA.crops_per_farm(d.farm_crops, d.crops)),
        rounded("SELECT farm_id, array_to_string(crops, '|') AS crops FROM farm_crop_names"),
    ),
    "agg03_crop_diversity": (
        lambda d: FA.crop_diversity(d.farms, d.farm_crops),
        rounded("SELECT farmer_profile_id, score AS crop_diversity_score FROM diversity"),
    ),
    "top01_fn26_registered_fields": (
        lambda d: plain(FA.registered_fields(d.farmers, 200)),
        rounded("""SELECT user_id AS field_id, latitude, longitude, coalesce(nullif(trim(crops[1]), ''), 'Maize') AS crop FROM farmers
                   WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY user_id LIMIT 200""", "latitude", "longitude"),
    ),
    "flt08_refused_coordinates": (
        lambda d: plain(FA.split_by_coordinates(d.farmers)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first_id"))),
        rounded("""SELECT CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'missing coordinates' ELSE 'coordinates out of range' END AS reason,
                   count(*) AS n, min(user_id) AS first_id FROM farmers
                   WHERE latitude IS NULL OR longitude IS NULL OR latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180 GROUP BY 1"""),
    ),
    "flt09_well_formed_ids": (
        lambda d: d.raw("customer").select("c_custkey", F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.col("c_name")).otherwise(
            F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"))).alias("ref"))
        .filter(FR.well_formed_id(F.col("ref"))),
        rounded("""SELECT c_custkey, '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS ref FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"""),
    ),
    "join16_feature_source": (
        lambda d: _source_choice(d),
        rounded("""SELECT f.field_id, f.crop, CASE WHEN s.last BETWEEN TIMESTAMP '2001-07-30 12:00:00' - INTERVAL 48 HOUR AND TIMESTAMP '2001-07-30 12:00:00'
                   THEN 'precomputed' ELSE 'live' END AS feature_source, r.dsv_total, r.ndvi
                   FROM fields f JOIN field_rows r ON r.field_id = f.field_id LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) s ON s.o_custkey = f.field_id""", "ndvi"),
    ),
    "job09_nightly_run": (
        _nightly,
        rounded("""SELECT count(*) AS fields, count(r.field_id) AS ok, count(*) FILTER (WHERE r.index_source <> 'sentinel-2') AS degraded,
                          count(*) FILTER (WHERE r.field_id IS NULL) AS failed, 0 AS pruned,
                          round_even(CASE WHEN count(r.field_id) > 0 THEN count(*) FILTER (WHERE r.index_source <> 'sentinel-2') / count(r.field_id) END, 3) AS degraded_rate,
                          count(r.field_id) AS stored, count(*) FILTER (WHERE r.field_id IS NULL) AS rejects
                   FROM fields f LEFT JOIN field_rows r ON r.field_id = f.field_id""", "degraded_rate"),
    ),
    "job07_fn35_coldstart_scoring": (
        lambda d: plain(_coldstart(d)),
        rounded(f"""SELECT field_id, crop, risk_score, round_even(value_at_risk * loss, 2) AS expected_loss,
                    CASE WHEN risk_score >= 65 THEN 'CRITICAL' WHEN risk_score >= 35 THEN 'ELEVATED' WHEN risk_score >= 15 THEN 'WATCH' ELSE 'NORMAL' END AS severity,
                    value_at_risk, v_score, stage FROM (
                    SELECT *, combined * (0.5e0 + 0.5e0 * v_score) * 0.6e0 AS loss, round_even(100e0 * least(1e0, combined * (0.5e0 + 0.5e0 * v_score) * 0.6e0 / 0.6e0), 1) AS risk_score FROM (
                    SELECT h.*, round_even(1e0 - (0.8e0 * 0.25e0 + 0.45e0 + 0.6e0 * 0.5e0) / 5.4e0, 3) AS v_score,
                           round_even(1e0 - (1e0 - greatest({O.clamp('(1e0 - ws - 0.15e0) / 0.5e0')}, {O.clamp('(dry_run_30 - 7) / 14e0')})) * (1e0 - {O.clamp('dsv_total / 18e0')})
                             * (1e0 - {O.clamp('heat / 3e0')}) * (1e0 - CASE WHEN index_source = 'sentinel-2' THEN {O.veg('ndvi_z_peer')} ELSE 0e0 END), 3) AS combined,
                           round_even(greatest(0e0, ha * round_even(greatest(0.5e0, least(5e0, 1.5e0 + (ndvi - 0.4e0) * 3.5e0)), 2) * CASE crop WHEN 'Rice' THEN 420e0 ELSE 250e0 END), 2) AS value_at_risk
                    FROM (SELECT t.*, f.crop, f.ha, 'coldstart-' || format('{{:.4f}}', f.latitude) || '-' || format('{{:.4f}}', f.longitude) AS field_id,
                                 {O.weather_features('t', 'f.crop')['water_satisfaction_30']} AS ws, {O.weather_features('t', 'f.crop')['heat_stress_days']} AS heat,
                                 {O.stage('round_even(t.heat_since_onset, 1)', 'f.crop')} AS stage
                          FROM site_state t JOIN (SELECT site_id, latitude, longitude, CASE WHEN cluster IN ('ASIA', 'EUROPE') THEN 'Rice' ELSE 'Maize' END AS crop,
                                                         CASE WHEN cluster <> 'ASIA' THEN 2e0 ELSE 1.5e0 END AS ha FROM sites) f ON f.site_id = t.site_id) h))""",
                "risk_score", "expected_loss", "value_at_risk", "v_score"),
    ),
    "ml10_fn33_fn34_encoder_inputs": (lambda d: plain(_embedding_inputs(d), 5), rounded(_EMBED_SQL, *[f"x_{c}" for c in K.CHANNELS], "missing", digits=5)),
    "agg24_sites_without_bands": (
        lambda d: EM.sites_without_bands(d.sites.select("site_id"), d.band_obs.filter(F.col("b12") > 0.09), d.sites),
        rounded("""SELECT cluster, count(*) AS sites_without_bands FROM sites WHERE site_id NOT IN (SELECT site_id FROM bands WHERE b12 > 0.09e0) GROUP BY 1"""),
    ),
}
