"""Shared SQL text for the oracle: domain tables and feature steps as common table expressions.

Written independently of the Spark plans: calendars come from generated days, windows from SQL frames,
dry runs from islands. ``0.08e0`` style literals keep the arithmetic in DOUBLE.
"""

from __future__ import annotations

import re

from cropspark import constants as K


def _pct(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def _interval(date: str) -> str:
    return f"date_diff('day', DATE '1995-01-01', CAST({date} AS DATE)) // 30"


def _radical(n: str, base: int) -> str:
    return (
        f"list_sum(list_transform(range(0, 38), lambda p: (({n}) // CAST(pow({base}, p) AS BIGINT) % {base}) "
        f"/ pow({base}.0e0, p + 1)))"
    )


def clamp(x: str) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(0e0, least(1e0, {x})) END"


def gdd(lo: str, hi: str) -> str:
    return f"greatest(0e0, (least({hi}, 30e0) + greatest(least({lo}, 30e0), 10e0)) / 2e0 - 10e0)"


def stage(gdd_col: str, crop: str | None = None) -> str:
    def one(name: str) -> str:
        arms = " ".join(f"WHEN {gdd_col} < {t} THEN '{s}'" for t, s in K.CROP_STAGES[name])
        return f"CASE {arms} ELSE 'Post-Harvest' END"

    if crop is None:
        return one("maize")
    return (
        f"CASE lower(trim({crop})) WHEN 'sorghum' THEN {one('sorghum')} WHEN 'rice' THEN {one('rice')} "
        f"ELSE {one('maize')} END"
    )


def kc(stage_col: str) -> str:
    arms = " ".join(f"WHEN '{s}' THEN {v}e0" for s, v in K.KC_BY_STAGE.items())
    return f"CASE {stage_col} {arms} ELSE 1e0 END"


def vci(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ({hi}) - ({lo}) <= 1e-6 THEN 50e0 ELSE ({clamp(f'(({x}) - ({lo})) / (({hi}) - ({lo}))')}) * 100e0 END"


def ref_z(x: str, mu: str, sd: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR {mu} IS NULL THEN NULL WHEN {sd} IS NULL OR {sd} <= 1e-9 THEN 0e0 "
        f"ELSE ({x} - {mu}) / {sd} END"
    )


def stress(z: str) -> str:
    return f"CASE WHEN {z} <= -1e0 THEN 2 WHEN {z} <= -0.35e0 THEN 1 ELSE 0 END"


def health(x: str, m: str, lo: str, hi: str, mean: str, sd: str) -> str:
    """Unrounded score."""
    z = f"CASE WHEN {sd} <= 1e-6 THEN 0e0 ELSE ({x} - {mean}) / {sd} END"
    moist = clamp(f"({m} + 0.2e0) / 0.6e0")
    return (
        f"100e0 * (0.4e0 * ({vci(x, lo, hi)}) / 100e0 + 0.3e0 * ({moist}) + 0.3e0 * (1e0 / (1e0 + exp(-({z})))))"
    )


def health_status(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 70 THEN 'Healthy' WHEN {score} >= 45 THEN 'Marginal' "
        f"WHEN {score} >= 25 THEN 'Stressed' ELSE 'Severely Stressed' END"
    )


CTES: dict[str, str] = {}

CTES["clusters"] = """
SELECT r_name AS cluster, r_regionkey AS cluster_idx, r_regionkey * 2e0 AS lat0, r_regionkey * 2e0 + 2e0 AS lat1,
       6e0 AS lon0, 9e0 AS lon1
FROM region"""

CTES["sites"] = f"""
SELECT s_suppkey AS site_id, cluster || '-' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(3, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS site_name,
       cluster, cluster_idx,
       round_even(lat0 + {_radical('s_suppkey + 7', 2)} * (lat1 - lat0), 4) AS latitude,
       round_even(lon0 + {_radical('s_suppkey + 7', 3)} * (lon1 - lon0), 4) AS longitude,
       greatest(0e0, s_acctbal) / 10e0 AS elevation,
       ['click', 'error', 'purchase', 'signup', 'view'][cluster_idx + 1] AS station
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN clusters ON n_regionkey = cluster_idx"""

CTES["daily"] = f"""
SELECT l_suppkey AS site_id, CAST(l_shipdate AS DATE) AS date,
       20e0 + 1.5e0 * floor(max(l_extendedprice) / 9000) AS tmax,
       20e0 + 1.5e0 * floor(max(l_extendedprice) / 9000) - 6e0 - 1.5e0 * max({_pct('l_discount')}) AS tmin,
       floor(greatest(0e0, sum(l_quantity) - 15e0) / 2) / 2e0 AS rain,
       3e0 + 0.5e0 * max({_pct('l_tax')}) AS et0,
       60e0 + 4e0 * max({_pct('l_tax')}) AS rh,
       CASE WHEN max(l_extendedprice) >= 2500 THEN 0.5e0 * floor(max(l_extendedprice) / 2000) END AS radiation
FROM lineitem GROUP BY 1, 2"""

CTES["means_ship"] = f"""
SELECT l_suppkey AS site_id, {_interval('l_shipdate')} AS idx, count(*) AS n,
       sum({_pct('l_discount')}) AS disc, sum({_pct('l_tax')}) AS tax
FROM lineitem GROUP BY 1, 2"""

CTES["optical"] = """
SELECT site_id, DATE '1995-01-01' + CAST(idx * 30 + 29 AS INTEGER) AS sensing_date,
       CASE WHEN n >= 2 THEN disc * 0.08e0 / n END AS ndvi,
       tax * 0.064e0 / n - 0.2e0 AS ndwi,
       CASE WHEN n >= 2 THEN disc * 0.08e0 / n END * 1.1e0 AS evi
FROM means_ship"""

CTES["bands"] = "\nSELECT site_id, DATE '1995-01-01' + CAST(idx * 30 + 29 AS INTEGER) AS sensing_date,\n" + ",\n".join(
    f"       (disc * {i + 1} + tax) / (n * 1000e0) AS {k}" for i, k in enumerate(K.BAND_KEYS)
) + "\nFROM means_ship"

CTES["means_order"] = f"""
SELECT l_suppkey AS site_id, {_interval('o_orderdate')} AS idx, count(*) AS n,
       sum({_pct('l_discount')}) AS disc, sum({_pct('l_tax')}) AS tax
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""

CTES["radar"] = """
SELECT site_id, DATE '1995-01-01' + CAST(idx * 30 + 12 AS INTEGER) AS sensing_date,
       tax / (n * 100e0) AS vv, disc / (n * 200e0) AS vh,
       CASE WHEN tax / (n * 100e0) + disc / (n * 200e0) > 0
            THEN 4e0 * (disc / (n * 200e0)) / (tax / (n * 100e0) + disc / (n * 200e0)) ELSE 0e0 END AS rvi
FROM means_order"""

CTES["hourly"] = """
SELECT event_type AS site_id, date_trunc('hour', ts) AS ts,
       5e0 + arg_min(value, event_id) % 25e0 AS temp,
       80e0 + floor(arg_min(value, event_id)) % 21 AS rh
FROM events GROUP BY 1, 2"""

CTES["farms"] = """
SELECT o_orderkey AS id, o_custkey AS farmer_profile_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown'
            ELSE CAST(CAST(floor(o_totalprice / 100000) AS BIGINT) AS VARCHAR) || '.5 ha' END AS farm_size,
       o_orderstatus AS state,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderdate END AS created_at
FROM orders"""

CTES["farm_sites"] = "\nSELECT l_orderkey AS farm_id, min(l_suppkey) AS site_id FROM lineitem GROUP BY 1"

CTES["farm_crops"] = "\nSELECT l_orderkey AS farm_id, l_partkey AS crop_id FROM lineitem"

CTES["crops"] = """
SELECT p_partkey AS id, CASE p_type WHEN 'STANDARD' THEN 'Maize' WHEN 'MEDIUM' THEN 'Sorghum' WHEN 'PROMO' THEN 'Rice'
       WHEN 'LARGE' THEN 'Cassava' WHEN 'SMALL' THEN 'maize' WHEN 'ECONOMY' THEN ' Millet ' END AS name
FROM part"""

CTES["survey"] = """
SELECT c_custkey AS farmer_id,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 0e0 WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal / 2500e0 END AS yield_value,
       CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment IN ('BUILDING', 'FURNITURE') END AS has_extension_access,
       c_acctbal > 5000 AS used_fertilizer,
       CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_acctbal > 2000 END AS received_credit,
       CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_acctbal / 100e0 END AS asset_score,
       c_nationkey * 4e0 AS market_access_score
FROM customer WHERE c_acctbal >= 0"""

CTES["predictions"] = """
SELECT o_orderkey AS id, o_custkey AS field_id, o_orderdate AS predicted_at, o_orderpriority AS model_version,
       floor(o_totalprice / 5000e0) AS risk_score,
       CASE WHEN floor(o_totalprice / 5000e0) >= 65 THEN 'CRITICAL' WHEN floor(o_totalprice / 5000e0) >= 35 THEN 'ELEVATED'
            WHEN floor(o_totalprice / 5000e0) >= 15 THEN 'WATCH' ELSE 'NORMAL' END AS severity
FROM orders"""

CTES["outcomes"] = """
SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey END AS prediction_id, o_custkey AS field_id, l_shipdate AS observed_at,
       CASE l_returnflag WHEN 'A' THEN 'agent_visit' WHEN 'N' THEN 'diagnosis' ELSE 'harvest' END AS outcome_type,
       l_linestatus = 'F' AS stress_confirmed,
       CASE WHEN l_linenumber <> 2 THEN l_quantity END AS yield_t_ha
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

# --- calendars -------------------------------------------------------------------------------

CTES["coverage"] = """
SELECT site_id, min(date) AS start_date, max(date) AS end_date FROM daily GROUP BY 1
HAVING count(tmax) > 0 AND count(tmin) > 0 AND count(rain) > 0 AND count(et0) > 0 AND count(rh) > 0 AND count(radiation) > 0"""

CTES["day_grid"] = """
SELECT site_id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM coverage"""

CTES["dense"] = "\nSELECT g.site_id, g.date, row_number() OVER w - 1 AS idx,\n" + ",\n".join(
    f"       coalesce(last_value(d.{v} IGNORE NULLS) OVER up, first_value(d.{v} IGNORE NULLS) OVER whole) AS {v}"
    for v in K.WEATHER_VARS
) + """
FROM day_grid g LEFT JOIN daily d ON d.site_id = g.site_id AND d.date = g.date
WINDOW w AS (PARTITION BY g.site_id ORDER BY g.date),
       up AS (PARTITION BY g.site_id ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       whole AS (PARTITION BY g.site_id ORDER BY g.date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

CTES["rain_before"] = """
SELECT site_id, date, idx, count(*) OVER (PARTITION BY site_id) AS n_days,
       sum(rain) OVER (PARTITION BY site_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS total
FROM dense"""

# --- observations, labels, peers ---------------------------------------------------------------

CTES["history"] = """
SELECT o.*, min(ndvi) OVER b AS past_min, max(ndvi) OVER b AS past_max, count(*) OVER (PARTITION BY o.site_id) AS n_obs,
       lead(sensing_date) OVER s AS next_date, lead(ndvi) OVER s AS next_ndvi
FROM optical o
WINDOW s AS (PARTITION BY o.site_id ORDER BY sensing_date),
       b AS (PARTITION BY o.site_id ORDER BY sensing_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

CTES["usable"] = """
SELECT h.*, c.start_date, c.end_date, s.cluster, s.latitude, s.longitude, s.elevation
FROM history h JOIN coverage c ON h.site_id = c.site_id JOIN sites s ON h.site_id = s.site_id WHERE h.n_obs >= 6"""

CTES["label_pairs"] = """
SELECT a.site_id, a.sensing_date, a.next_ndvi, avg(p.ndvi) AS mean, stddev_pop(p.ndvi) AS sd, count(p.ndvi) AS n
FROM usable a JOIN usable p ON p.cluster = a.cluster AND p.sensing_date = a.next_date AND p.ndvi <> a.next_ndvi
WHERE a.ndvi IS NOT NULL AND a.next_date - a.sensing_date <= 45
GROUP BY 1, 2, 3"""

CTES["labelled"] = f"""
SELECT u.*, round_even((u.next_ndvi - l.mean) / l.sd, 4) AS forward_z,
       {stress('(u.next_ndvi - l.mean) / l.sd')} AS label
FROM usable u JOIN label_pairs l ON u.site_id = l.site_id AND u.sensing_date = l.sensing_date
WHERE l.n >= 5 AND l.sd >= 1e-6"""

CTES["radar_near"] = """
SELECT o.site_id, o.sensing_date, r.sensing_date AS radar_date, r.vv, r.vh, r.rvi
FROM optical o JOIN radar r ON r.site_id = o.site_id AND abs(r.sensing_date - o.sensing_date) <= 20
QUALIFY row_number() OVER (PARTITION BY o.site_id, o.sensing_date
                           ORDER BY abs(r.sensing_date - o.sensing_date), r.sensing_date) = 1"""

CTES["canopy"] = f"""
SELECT l.site_id, l.cluster, l.sensing_date AS obs_date, l.next_date AS label_date, l.label, l.forward_z,
       l.latitude, l.longitude, l.elevation,
       round_even(l.ndvi, 4) AS ndvi, round_even(l.ndwi, 4) AS ndmi, round_even(l.evi, 4) AS evi,
       round_even({vci('l.ndvi', 'coalesce(l.past_min, l.ndvi)', 'coalesce(l.past_max, l.ndvi)')}, 2) AS vci,
       round_even(r.rvi, 4) AS rvi, round_even(CASE WHEN r.vv <> 0 THEN r.vh / r.vv END, 4) AS vh_vv_ratio
FROM labelled l LEFT JOIN radar_near r ON r.site_id = l.site_id AND r.sensing_date = l.sensing_date
WHERE l.sensing_date - l.start_date >= 90 AND l.sensing_date <= l.end_date"""

CTES["peer_ref"] = """
SELECT cluster, month(obs_date) AS m, avg(ndvi) AS ndvi_mu, stddev_samp(ndvi) AS ndvi_sigma,
       avg(rvi) AS rvi_mu, stddev_samp(rvi) AS rvi_sigma
FROM canopy GROUP BY 1, 2"""

CTES["canopy_z"] = f"""
SELECT c.*, {ref_z('c.ndvi', 'p.ndvi_mu', 'p.ndvi_sigma')} AS ndvi_z_peer, {ref_z('c.rvi', 'p.rvi_mu', 'p.rvi_sigma')} AS rvi_z_peer
FROM canopy c LEFT JOIN peer_ref p ON p.cluster = c.cluster AND p.m = month(c.obs_date)"""

# --- look-back windows: {ref_day} rows (site_id, ref_day, last) where last is the closing day of the window ---

CTES["asof_train"] = "\nSELECT site_id, obs_date AS ref_day, obs_date - 1 AS last FROM canopy"
CTES["asof_score"] = "\nSELECT site_id, end_date AS ref_day, end_date AS last FROM coverage WHERE end_date - start_date + 1 >= 90"


def _window_ctes(kind: str, clim_filter: str) -> None:
    a, pre = f"asof_{kind}", kind
    CTES[f"{pre}_days"] = f"""
SELECT a.site_id, a.ref_day, CAST(89 - (a.last - d.date) AS INTEGER) AS i, d.tmax, d.tmin, d.rain, d.et0, d.rh, d.radiation
FROM {a} a JOIN dense d ON d.site_id = a.site_id AND d.date BETWEEN a.last - 89 AND a.last"""
    CTES[f"{pre}_islands"] = f"""
SELECT site_id, ref_day, i, i - row_number() OVER (PARTITION BY site_id, ref_day ORDER BY i) AS grp
FROM {pre}_days WHERE rain < 1"""
    CTES[f"{pre}_runs90"] = f"""
SELECT site_id, ref_day, max(n) AS run FROM (SELECT site_id, ref_day, grp, count(*) AS n FROM {pre}_islands GROUP BY ALL) GROUP BY 1, 2"""
    CTES[f"{pre}_runs30"] = f"""
SELECT site_id, ref_day, max(n) AS run FROM (SELECT site_id, ref_day, grp, count(*) AS n FROM {pre}_islands WHERE i >= 60 GROUP BY ALL) GROUP BY 1, 2"""
    CTES[f"{pre}_marks"] = f"""
SELECT site_id, ref_day, string_agg(CASE WHEN rain < 1 THEN 'd' ELSE 'w' END, '' ORDER BY i) AS marks FROM {pre}_days GROUP BY 1, 2"""
    CTES[f"{pre}_spells"] = f"""
SELECT site_id, ref_day, i, sum(rain) OVER (PARTITION BY site_id, ref_day ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS wet
FROM {pre}_days"""
    CTES[f"{pre}_onset"] = f"""
SELECT s.site_id, s.ref_day, min(s.i) AS onset FROM {pre}_spells s JOIN {pre}_marks m ON m.site_id = s.site_id AND m.ref_day = s.ref_day
WHERE s.i <= 86 AND s.wet >= 20 AND strpos(substr(m.marks, s.i + 4, 30), 'dddddddddd') = 0 GROUP BY 1, 2"""
    CTES[f"{pre}_clim"] = f"""
SELECT a.site_id, a.ref_day, avg(r.total) AS clim FROM {a} a JOIN rain_before r ON r.site_id = a.site_id
 AND strftime(r.date, '%m-%d') = strftime(a.ref_day, '%m-%d') AND {clim_filter} GROUP BY 1, 2"""
    CTES[f"{pre}_totals"] = f"""
SELECT d.site_id, d.ref_day, count(*) AS n, sum({gdd('d.tmin', 'd.tmax')}) AS heat_sum_90,
       coalesce(sum({gdd('d.tmin', 'd.tmax')}) FILTER (WHERE d.i >= o.onset), 0e0) AS heat_since_onset,
       CAST(coalesce(90 - max(o.onset), 0) AS INTEGER) AS days_since_onset,
       sum(d.tmax) FILTER (WHERE d.i >= 60) AS tmax_sum_30, sum(d.tmin) FILTER (WHERE d.i >= 60) AS tmin_sum_30,
       count(*) FILTER (WHERE d.i >= 60 AND d.tmax >= 35) AS hot_days_30,
       sum(d.rain) FILTER (WHERE d.i >= 60) AS rain_sum_30, sum(d.rain) AS rain_sum_90,
       sum(d.et0) FILTER (WHERE d.i >= 60) AS et0_sum_30, sum(d.et0) AS et0_sum_90,
       sum(d.rh) FILTER (WHERE d.i >= 60) AS rh_sum_30, sum(d.radiation) AS radiation_sum_90,
       CAST(coalesce(max(r30.run), 0) AS INTEGER) AS dry_run_30, CAST(coalesce(max(r90.run), 0) AS INTEGER) AS dry_run_90,
       max(c.clim) AS clim
FROM {pre}_days d LEFT JOIN {pre}_onset o ON o.site_id = d.site_id AND o.ref_day = d.ref_day
LEFT JOIN {pre}_runs30 r30 ON r30.site_id = d.site_id AND r30.ref_day = d.ref_day
LEFT JOIN {pre}_runs90 r90 ON r90.site_id = d.site_id AND r90.ref_day = d.ref_day
LEFT JOIN {pre}_clim c ON c.site_id = d.site_id AND c.ref_day = d.ref_day
GROUP BY 1, 2 HAVING count(*) = 90"""


_window_ctes("train", "r.idx >= 30 AND year(r.date) <> year(a.ref_day)")
_window_ctes("score", "r.idx >= 30 + greatest(0, r.n_days - 1460)")


def weather_features(t: str, crop: str | None = None) -> dict[str, str]:
    """SQL of the 18 weather columns from a totals row aliased ``t``."""
    st = stage(f"{t}.heat_since_onset", crop)
    need = f"({kc(st)}) * {t}.et0_sum_30"
    return {
        "gdd_90": f"round_even({t}.heat_sum_90, 1)",
        "gdd_since_onset": f"round_even({t}.heat_since_onset, 1)",
        "tmax_mean_30": f"round_even({t}.tmax_sum_30 / 30e0, 2)",
        "tmin_mean_30": f"round_even({t}.tmin_sum_30 / 30e0, 2)",
        "diurnal_range_30": f"round_even(({t}.tmax_sum_30 - {t}.tmin_sum_30) / 30e0, 2)",
        "heat_stress_days": f"CAST(CASE WHEN ({st}) = 'Flowering' THEN {t}.hot_days_30 ELSE 0 END AS INTEGER)",
        "rain_30": f"round_even({t}.rain_sum_30, 1)",
        "rain_90": f"round_even({t}.rain_sum_90, 1)",
        "et0_90": f"round_even({t}.et0_sum_90, 1)",
        "water_satisfaction_30": f"round_even(CASE WHEN {need} <= 1e-6 THEN 1e0 ELSE least(1e0, {t}.rain_sum_30 / ({need})) END, 3)",
        "water_deficit_30": f"round_even(greatest(0e0, {need} - {t}.rain_sum_30), 1)",
        "dry_spell_30": f"{t}.dry_run_30",
        "dry_spell_90": f"{t}.dry_run_90",
        "rain_anomaly_30": f"round_even({t}.rain_sum_30 - coalesce({t}.clim, {t}.rain_sum_30), 1)",
        "rh_mean_30": f"round_even({t}.rh_sum_30 / 30e0, 1)",
        "radiation_90": f"round_even({t}.radiation_sum_90, 1)",
        "days_since_onset": f"{t}.days_since_onset",
        "stage_kc": kc(st),
    }


def _select(cols: dict[str, str]) -> str:
    return ",\n       ".join(f"{v} AS {k}" for k, v in cols.items())


CTES["samples"] = f"""
SELECT {_select(weather_features('t'))},
       z.ndvi, z.ndmi, z.evi, z.vci, z.ndvi_z_peer, z.latitude, z.longitude, z.elevation, z.rvi, z.vh_vv_ratio, z.rvi_z_peer,
       z.label, z.forward_z, z.site_id, z.cluster, z.obs_date, z.label_date
FROM train_totals t JOIN canopy_z z ON z.site_id = t.site_id AND z.obs_date = t.ref_day"""

# Samples without the weather windows: what the peer, baseline and evaluation queries need.
CTES["canopy_clim"] = """
SELECT z.*, coalesce(avg(ndvi_z_peer) OVER (PARTITION BY site_id ORDER BY obs_date
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS clim_z_prior
FROM canopy_z z"""

# --- farmers -----------------------------------------------------------------------------------

CTES["located"] = """
SELECT f.*, fs.site_id, s.latitude + CASE WHEN f.farm_size = 'unknown' AND f.state = 'P' THEN 100e0 ELSE 0e0 END AS latitude, s.longitude
FROM farms f LEFT JOIN farm_sites fs ON fs.farm_id = f.id LEFT JOIN sites s ON s.site_id = fs.site_id"""

CTES["latest_farm"] = """
SELECT * FROM located QUALIFY row_number() OVER (PARTITION BY farmer_profile_id ORDER BY created_at DESC NULLS LAST, id DESC) = 1"""

CTES["farm_crop_names"] = """
SELECT fc.farm_id, array_agg(c.name ORDER BY c.name) AS crops FROM farm_crops fc JOIN crops c ON c.id = fc.crop_id GROUP BY 1"""

CTES["diversity"] = """
SELECT f.farmer_profile_id, count(DISTINCT fc.crop_id) AS score FROM farm_crops fc JOIN farms f ON f.id = fc.farm_id GROUP BY 1"""

CTES["farmers"] = """
SELECT c.c_custkey AS user_id, f.id AS farm_id, f.farm_size, f.state, f.created_at, f.site_id, f.latitude, f.longitude,
       n.crops, s.yield_value, s.has_extension_access, s.used_fertilizer, s.received_credit, s.asset_score, s.market_access_score,
       coalesce(d.score, 0) AS crop_diversity_score
FROM customer c LEFT JOIN latest_farm f ON f.farmer_profile_id = c.c_custkey
LEFT JOIN farm_crop_names n ON n.farm_id = f.id LEFT JOIN survey s ON s.farmer_id = c.c_custkey
LEFT JOIN diversity d ON d.farmer_profile_id = c.c_custkey"""

CTES["fields"] = """
SELECT user_id AS field_id, site_id, latitude, longitude, coalesce(nullif(trim(crops[1]), ''), 'Maize') AS crop
FROM farmers WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180"""

# --- scoring -----------------------------------------------------------------------------------

CTES["hour_days"] = """
SELECT site_id, CAST(ts AS DATE) AS day, hour(ts) AS hr, temp, rh, max(CAST(ts AS DATE)) OVER (PARTITION BY site_id) AS last_day,
       max(CAST(ts AS DATE)) OVER () AS as_of FROM hourly"""

CTES["wet_days"] = """
SELECT site_id, day, CAST(count(CASE WHEN rh >= 90 THEN temp END) AS INTEGER) AS wet_hours, any_value(as_of) AS as_of,
       coalesce(avg(CASE WHEN rh >= 90 THEN temp END), avg(temp)) AS wet_temp
FROM hour_days GROUP BY site_id, day, last_day HAVING count(temp) > 0 AND (day < last_day OR max(hr) = 23)"""


def dsv(temp: str, hours: str) -> str:
    def cuts(table) -> str:
        return "CASE " + " ".join(f"WHEN {hours} >= {h} THEN {v}" for h, v in table) + " ELSE 0 END"

    arms = " ".join(f"WHEN {temp} BETWEEN {lo}e0 AND {hi}e0 THEN {cuts(t)}" for lo, hi, t in K.SEVERITY_BANDS)
    return f"CASE {arms} ELSE 0 END"


CTES["dsv_totals"] = f"""
SELECT site_id AS station, CAST(sum({dsv('wet_temp', 'wet_hours')}) AS BIGINT) AS dsv_total FROM wet_days WHERE day > as_of - 15 GROUP BY 1"""

CTES["recent_optical"] = """
SELECT o.*, a.ref_day FROM optical o JOIN asof_score a ON a.site_id = o.site_id
WHERE o.ndvi IS NOT NULL AND o.ndwi IS NOT NULL AND o.evi IS NOT NULL AND a.ref_day - o.sensing_date BETWEEN 0 AND 365"""

CTES["recent_radar"] = """
SELECT r.* FROM radar r JOIN asof_score a ON a.site_id = r.site_id WHERE a.ref_day - r.sensing_date BETWEEN 0 AND 365"""

CTES["site_canopy"] = """
SELECT site_id, max(sensing_date) AS sensing_date, arg_max(ndvi, sensing_date) AS ndvi, arg_max(ndwi, sensing_date) AS ndwi,
       arg_max(evi, sensing_date) AS evi, count(*) AS observations, min(ndvi) AS low, max(ndvi) AS high,
       avg(ndvi) AS mean, stddev_pop(ndvi) AS sd
FROM recent_optical GROUP BY 1"""

CTES["site_past"] = """
SELECT c.site_id, min(o.ndvi) AS past_min, max(o.ndvi) AS past_max
FROM site_canopy c JOIN recent_optical o ON o.site_id = c.site_id AND o.sensing_date < c.sensing_date GROUP BY 1"""

CTES["site_radar"] = """
SELECT c.site_id, r.vv, r.vh, r.rvi FROM site_canopy c JOIN recent_radar r
  ON r.site_id = c.site_id AND abs(r.sensing_date - c.sensing_date) <= 20
QUALIFY row_number() OVER (PARTITION BY c.site_id ORDER BY abs(r.sensing_date - c.sensing_date), r.sensing_date) = 1"""

CTES["zoned"] = """
SELECT s.site_id, min_by(c.cluster, c.cluster_idx) AS zone FROM sites s LEFT JOIN clusters c
  ON s.latitude BETWEEN c.lat0 AND c.lat1 AND s.longitude BETWEEN c.lon0 AND c.lon1 GROUP BY 1"""

CTES["site_state"] = f"""
SELECT t.*, s.elevation, z.zone AS cluster, c.sensing_date,
       CASE WHEN c.site_id IS NULL THEN 'unavailable' ELSE 'sentinel-2' END AS index_source,
       CASE WHEN c.site_id IS NULL THEN 0e0 ELSE round_even(c.ndvi, 4) END AS ndvi,
       CASE WHEN c.site_id IS NULL THEN 0e0 ELSE round_even(c.ndwi, 4) END AS ndmi,
       CASE WHEN c.site_id IS NULL THEN 0e0 ELSE round_even(c.evi, 4) END AS evi,
       CASE WHEN c.site_id IS NULL THEN 50e0
            ELSE round_even({vci('c.ndvi', 'coalesce(p.past_min, c.ndvi)', 'coalesce(p.past_max, c.ndvi)')}, 2) END AS vci,
       round_even(r.rvi, 4) AS rvi, round_even(CASE WHEN r.vv <> 0 THEN r.vh / r.vv END, 4) AS vh_vv_ratio,
       CASE WHEN c.site_id IS NULL THEN 0e0
            ELSE round_even({ref_z('round_even(c.ndvi, 4)', 'pr.ndvi_mu', 'pr.ndvi_sigma')}, 3) END AS ndvi_z_peer,
       round_even({ref_z('round_even(r.rvi, 4)', 'pr.rvi_mu', 'pr.rvi_sigma')}, 3) AS rvi_z_peer,
       CASE WHEN c.site_id IS NOT NULL THEN {health('c.ndvi', 'c.ndwi', 'c.low', 'c.high', 'c.mean', 'c.sd')} END AS health_raw,
       coalesce(d.dsv_total, 0) AS dsv_total, coalesce(d.dsv_total, 0) >= 18 AS spray_due
FROM score_totals t JOIN sites s ON s.site_id = t.site_id LEFT JOIN zoned z ON z.site_id = t.site_id
LEFT JOIN site_canopy c ON c.site_id = t.site_id LEFT JOIN site_past p ON p.site_id = t.site_id
LEFT JOIN site_radar r ON r.site_id = t.site_id
LEFT JOIN peer_ref pr ON pr.cluster = z.zone AND pr.m = month(c.sensing_date)
LEFT JOIN dsv_totals d ON d.station = s.station"""

CTES["field_rows"] = f"""
SELECT f.field_id, f.site_id, f.crop, t.ref_day, t.cluster,
       {_select(weather_features('t', 'f.crop'))},
       t.ndvi, t.ndmi, t.evi, t.vci, t.ndvi_z_peer, f.latitude, f.longitude, t.elevation, t.rvi, t.vh_vv_ratio, t.rvi_z_peer,
       t.index_source, t.sensing_date, t.health_raw, t.dsv_total, t.spray_due,
       {stage('round_even(t.heat_since_onset, 1)', 'f.crop')} AS stage
FROM fields f JOIN site_state t ON t.site_id = f.site_id"""


def veg(z: str) -> str:
    return f"coalesce({clamp(f'1e0 / (1e0 + exp(({z} + 1e0) / 0.5e0))')}, 0e0)"


CTES["hazards"] = f"""
SELECT r.*, CASE WHEN index_source = 'sentinel-2' THEN {veg('ndvi_z_peer')} ELSE 0e0 END AS vegetation_raw,
       greatest({clamp('(1e0 - water_satisfaction_30 - 0.15e0) / 0.5e0')}, {clamp('(dry_spell_30 - 7) / 14e0')}) AS drought_raw,
       {clamp('dsv_total / 18e0')} AS disease_raw, {clamp('heat_stress_days / 3e0')} AS heat_raw
FROM field_rows r"""

CTES["coping"] = """
SELECT user_id AS field_id, farm_size, yield_value, 0e0 AS has_irrigation,
       CASE WHEN has_extension_access THEN 1e0 ELSE 0e0 END AS has_extension_access,
       CASE WHEN received_credit THEN 1e0 ELSE 0e0 END AS received_credit,
       CASE WHEN used_fertilizer THEN 1e0 ELSE 0e0 END AS used_fertilizer,
       least(1e0, crop_diversity_score / 4e0) AS crop_diversity,
       least(1e0, coalesce(asset_score, 45e0) / 100e0) AS asset_score,
       least(1e0, coalesce(market_access_score, 50e0) / 100e0) AS market_access
FROM farmers"""

_CAP = "(1.0e0 * has_irrigation + 0.8e0 * has_extension_access + 0.7e0 * received_credit + 0.5e0 * used_fertilizer + 0.8e0 * crop_diversity + 1.0e0 * asset_score + 0.6e0 * market_access) / 5.4e0"
CTES["vulnerable"] = f"""
SELECT field_id, farm_size, yield_value, round_even(1e0 - {_CAP}, 3) AS v_score, round_even({_CAP}, 3) AS capacity,
       list_filter([{', '.join(f"CASE WHEN {n} < 0.34e0 THEN '{n}' END" for n in K.COPING_WEIGHTS)}], lambda g: g IS NOT NULL) AS gaps
FROM coping"""

CTES["scored_parts"] = """
SELECT h.*, v.v_score, v.capacity, v.gaps,
       round_even(drought_raw, 3) AS drought, round_even(disease_raw, 3) AS disease, round_even(heat_raw, 3) AS heat,
       round_even(vegetation_raw, 3) AS vegetation,
       round_even(1e0 - (1e0 - drought_raw) * (1e0 - disease_raw) * (1e0 - heat_raw) * (1e0 - vegetation_raw), 3) AS combined,
       CASE WHEN NOT greatest(drought_raw, disease_raw, heat_raw, vegetation_raw) > 0.05e0 THEN 'none'
            WHEN drought_raw >= greatest(disease_raw, heat_raw, vegetation_raw) THEN 'drought'
            WHEN disease_raw >= greatest(heat_raw, vegetation_raw) THEN 'disease'
            WHEN heat_raw >= vegetation_raw THEN 'heat' ELSE 'vegetation' END AS dominant,
       round_even(greatest(0e0, coalesce(TRY_CAST(split_part(trim(v.farm_size), ' ', 1) AS DOUBLE), 1e0)
         * (CASE WHEN v.yield_value > 0 THEN v.yield_value
                 ELSE round_even(greatest(0.5e0, least(5e0, 1.5e0 + (h.ndvi - 0.4e0) * 3.5e0)), 2) END)
         * (CASE lower(h.crop) WHEN 'maize' THEN 250e0 WHEN 'sorghum' THEN 230e0 WHEN 'rice' THEN 420e0 WHEN 'cassava' THEN 120e0 ELSE 250e0 END)), 2) AS value_at_risk
FROM hazards h JOIN vulnerable v ON v.field_id = h.field_id"""

CTES["scored"] = """
SELECT p.*, round_even(100e0 * least(1e0, combined * (0.5e0 + 0.5e0 * v_score) * 0.6e0 / 0.6e0), 1) AS risk_score,
       round_even(value_at_risk * (combined * (0.5e0 + 0.5e0 * v_score) * 0.6e0), 2) AS expected_loss
FROM scored_parts p"""

CTES["ranked"] = """
SELECT s.*, CASE WHEN risk_score >= 65 THEN 'CRITICAL' WHEN risk_score >= 35 THEN 'ELEVATED' WHEN risk_score >= 15 THEN 'WATCH' ELSE 'NORMAL' END AS severity
FROM scored s"""


def with_ctes(body: str) -> str:
    """Prefix a query with the expressions it needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    heads = [f"{n} AS {'MATERIALIZED ' if n in _HEAVY else ''}({CTES[n]}\n)" for n in order]
    return decimal_rounding(("WITH " + ",\n".join(heads) + "\n" if heads else "") + body.strip())


def decimal_rounding(sql: str) -> str:
    """Round half to even on the shortest decimal form of a double, as the engine's bround does.

    DuckDB rounds a DOUBLE by scaling it, which decides decimal ties such as 1.255 by binary noise; on a
    DECIMAL it rounds exactly.
    """
    out, i = [], 0
    while (start := sql.find("round_even(", i)) >= 0:
        out.append(sql[i:start])
        pos = begin = start + len("round_even(")
        depth, comma = 1, -1
        while depth:
            ch = sql[pos]
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and depth == 1:
                comma = pos
            pos += 1
        inner, digits = decimal_rounding(sql[begin:comma]), sql[comma + 1 : pos - 1].strip()
        out.append(f"CAST(round_even (CAST(CAST({inner} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)")
        i = pos
    return "".join(out) + sql[i:]


_HEAVY = {*(f"boost_{r}" for r in range(4)), *(f"boost_{r}_{n}_best" for r in range(3) for n in range(2)), "dense", "optical", "radar", "usable", "canopy", "train_days", "score_days", "samples", "farmers", "daily", "canopy_z"}


def rounded(body: str, *columns: str, digits: int = 6) -> str:
    """Round columns of a query; adding zero removes a negative zero."""
    if not columns:
        return with_ctes(body)
    repl = ", ".join(f"round_even({c}, {digits}) + 0e0 AS {c}" for c in columns)
    return with_ctes(f"SELECT * REPLACE ({repl}) FROM ({body.strip()})")
