"""Scans, sinks and store queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cropspark.constants import BAND_KEYS, OPTICAL_KEYS, RADAR_KEYS
from cropspark.operators.lookup import latest_by
from cropspark.queries.flatten import plain
from cropspark.queries.oracle import rounded
from cropspark.schemas import STORE_TABLES, WEATHER_PAYLOAD
from cropspark.sources import landed, store
from cropspark.sources.sites import sample_sites
from cropspark.streaming.runs import run_to_files, scratch

NOW = "2001-07-30 12:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _statistics(d, payloads, keys):
    return landed.statistics_payloads(d.spark, d.landed(payloads), keys)


def _feature_log(d):
    return d.raw("orders").select(
        F.col("o_custkey").alias("field_id"), F.col("o_orderdate").alias("computed_at"),
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("crop"),
    )


def _store_rows(rows):
    """Feature rows of the log, one computation a month, in the store's shape; latitude carries the log's row number."""
    rows = rows.withColumn("computed_at", F.date_trunc("month", "computed_at").cast("timestamp_ntz"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in STORE_TABLES["field_features"].fields}
    made = empty | {"field_id": F.col("field_id"), "computed_at": F.col("computed_at"), "crop": F.col("crop"), "latitude": F.col("row_id").cast("double")}
    return rows.select(*[c.alias(n) for n, c in made.items()])


def _idempotent_append(d):
    """The urgent rows are stored first, then the whole log twice; what is stored holds each key once."""
    root = scratch(d.spark, "store")
    log = _store_rows(_feature_log(d))
    store.append(store.new_rows(log.limit(0), log.filter(F.col("crop").isin("1-URGENT", "2-HIGH")), ["field_id", "computed_at"], ["latitude"]), root, "field_features")
    for _ in range(2):
        store.write_features(log, root)
    return store.read(d.spark, root, "field_features").select("field_id", "computed_at", F.col("latitude").cast("long").alias("row_id"), "crop")


def _pruned(d):
    """Rows older than the limit are dropped from a stored log; counted by what the store reports and holds."""
    root = scratch(d.spark, "store")
    store.append(_store_rows(_feature_log(d)), root, "field_features")
    pruned = store.prune_features(d.spark, root, dt.datetime.fromisoformat(NOW))
    kept = store.read(d.spark, root, "field_features")
    return kept.agg(F.lit(pruned).cast("long").alias("pruned"), F.count(F.lit(1)).alias("kept"), F.min("computed_at").cast("string").alias("oldest_kept"))


def _retried_append(d):
    """A batch told twice, one whose run died before its commit, and one whose run died after it: each counts once or not at all."""
    root = scratch(d.spark, "store")
    log = _store_rows(_feature_log(d))
    urgent, rest = F.col("crop").isin("1-URGENT", "2-HIGH"), ~F.col("crop").isin("1-URGENT", "2-HIGH")
    for _ in range(2):
        store.append(log.filter(urgent), root, "field_features", "night-1")
    day = F.to_date("computed_at").alias("day")
    log.select("*", day).write.partitionBy("day").parquet(f"{root}/field_features/{store.STAGING}/night-2-dead")
    files = store._Files(d.spark, f"{root}/field_features")
    log.filter(rest).select("*", day).write.partitionBy("day").parquet(files.at(f"{store.STAGING}/night-3-late"))
    store._commit(files, "night-3", f"{store.STAGING}/night-3-late", 0)
    stored = store.read(d.spark, root, "field_features")
    return stored.groupBy("crop").agg(F.count(F.lit(1)).alias("n"), F.sum("latitude").cast("long").alias("rows_sum"), F.max("computed_at").alias("last"))


def _retried_predictions(d):
    """Predictions written twice under one name; the second run adds nothing and still hands back its ids."""
    root = scratch(d.spark, "store")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in STORE_TABLES["predictions"].fields}
    made = empty | {c: F.col(c) for c in ("id", "field_id", "predicted_at", "model_version", "risk_score", "severity")}
    monthly = d.predictions.withColumn("predicted_at", F.date_trunc("month", "predicted_at"))
    rows = monthly.select(*[c.cast(STORE_TABLES["predictions"][n].dataType).alias(n) for n, c in made.items()])
    ids = [store.write_predictions(rows, root, "run-1") for _ in range(2)][-1]
    stored = store.read(d.spark, root, "predictions").join(ids.select("id"), "id", "left_semi")
    return stored.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("risk"), F.max("predicted_at").alias("last"))


def _quarantine(d):
    """Weather payloads of which some arrive cut off, with a wrong site, without a site or without days, met by a file stream."""
    text, site = F.to_json(F.struct("site_id", "daily")), F.col("site_id") % 7
    broken = (
        F.when(site == 0, F.substring(text, 1, 200))
        .when(site == 1, F.replace(text, F.concat(F.lit('"site_id":'), F.col("site_id")), F.lit('"site_id":"unknown"')))
        .when(site == 2, F.replace(text, F.concat(F.lit('"site_id":'), F.col("site_id"), F.lit(",")), F.lit("")))
        .when(site == 3, F.concat(F.lit('{"site_id":'), F.col("site_id"), F.lit("}")))
        .otherwise(text)
    )
    landing = scratch(d.spark, "landed")
    d.weather_payloads.select(broken.alias("value")).write.text(landing)
    out = run_to_files(landed.sifted(d.spark, landing, WEATHER_PAYLOAD, "daily"), "sifted")
    rows = d.spark.read.parquet(out)
    days = landed.daily_from_payload(landed.accepted(rows)).agg(F.count(F.lit(1)).alias("days")).withColumn("one", F.lit(1))
    counts = rows.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("payloads")).withColumn("one", F.lit(1))
    return counts.join(days, "one").select("reason", "payloads", F.when(F.col("reason") == "accepted", F.col("days")).alias("days"))


def _latest_of_buckets(d):
    """Latest fresh row per field from the feature log in buckets of the field, joined with the farmers' newest outcome."""
    log = store.by_field(_feature_log(d), "feature_log_by_field", scratch(d.spark, "by-field"))
    reports = store.by_field(d.outcomes.select("field_id", "observed_at", "outcome_type"), "outcomes_by_field", scratch(d.spark, "by-field"))
    newest = latest_by(log, ["field_id"], ["computed_at", "row_id"], ["computed_at", "row_id"])
    seen = reports.groupBy("field_id").agg(F.count(F.lit(1)).alias("reports"), F.max("observed_at").alias("last_report"))
    return newest.join(seen, "field_id", "left")


def _json_safe(d):
    """Shares with a zero denominator produce NaN and infinities, which must come out as NULL."""
    pct = F.round(F.col("l_discount") * 100)
    double_div = F.try_divide(pct, F.round(F.col("l_tax") * 100))
    broken = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(F.col("l_discount") == 0, F.lit(float("-inf"))).otherwise(double_div)
    rows = d.raw("lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", F.struct(broken.alias("ratio"), F.array(broken, pct).alias("pair")).alias("features")
    )
    safe = store.clean(rows)
    return safe.groupBy("l_linenumber").agg(
        F.count("features.ratio").alias("n_ratio"),
        F.sum(F.get("features.pair", F.lit(1))).alias("pct_sum"),
        F.count(F.get("features.pair", F.lit(0))).alias("n_pair"),
        F.avg("features.ratio").alias("mean_ratio"),
    )


QUERIES = {
    "src01_daily_weather_scan": (
        lambda d: plain(landed.daily_from_payload(landed.weather_payloads(d.spark, d.landed(d.weather_payloads)))),
        rounded("SELECT site_id, CAST(date AS VARCHAR) AS date, tmax, tmin, rain, et0, rh, radiation FROM daily",
                "tmax", "tmin", "rain", "et0", "rh", "radiation"),
    ),
    "src02_optical_scan": (
        lambda d: plain(landed.optical_observations(landed.landed_with_data(_statistics(d, d.optical_payloads, OPTICAL_KEYS)))),
        rounded("""SELECT site_id, CAST(sensing_date AS VARCHAR) AS sensing_date, ndvi, ndwi, evi FROM optical
                   WHERE ndvi <> 0 AND ndwi IS NOT NULL AND evi IS NOT NULL""", "ndvi", "ndwi", "evi"),
    ),
    "src03_radar_scan": (
        lambda d: plain(landed.radar_observations(_statistics(d, d.radar_payloads, RADAR_KEYS))),
        rounded("SELECT site_id, CAST(sensing_date AS VARCHAR) AS sensing_date, vv, vh, rvi FROM radar WHERE vv <> 0", "vv", "vh", "rvi"),
    ),
    "src04_band_scan": (
        lambda d: plain(landed.band_observations(_statistics(d, d.band_payloads, BAND_KEYS)), 9),
        rounded("SELECT * REPLACE (CAST(sensing_date AS VARCHAR) AS sensing_date) FROM bands WHERE b02 <> 0",
                "b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b11", "b12", digits=9),
    ),
    "src05_latest_optical": (
        lambda d: plain(latest_by(d.optical_obs.dropna(), ["site_id"], ["sensing_date"], ["sensing_date", "ndvi", "ndwi", "evi"])),
        rounded("""SELECT site_id, CAST(sensing_date AS VARCHAR) AS sensing_date, ndvi, ndwi, evi FROM optical
                   WHERE ndvi IS NOT NULL AND evi IS NOT NULL
                   QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY sensing_date DESC) = 1""", "ndvi", "ndwi", "evi"),
    ),
    "src06_hourly_scan": (
        lambda d: plain(landed.hourly_from_payload(landed.hourly_payloads(d.spark, d.landed(d.hourly_payloads)))),
        rounded("SELECT site_id, CAST(ts AS VARCHAR) AS ts, temp, rh FROM hourly", "temp", "rh"),
    ),
    "src01_src06_payload_quarantine": (
        lambda d: plain(_quarantine(d)),
        rounded("""SELECT reason, count(*) AS payloads, CASE WHEN reason = 'accepted' THEN CAST(sum(n) AS BIGINT) END AS days FROM (
                     SELECT CASE site_id % 7 WHEN 0 THEN 'no json' WHEN 1 THEN 'half parsed' WHEN 2 THEN 'no site' WHEN 3 THEN 'no series' ELSE 'accepted' END AS reason, n
                     FROM (SELECT site_id, count(*) AS n FROM daily GROUP BY 1)) GROUP BY 1"""),
    ),
    "src10_retried_feature_append": (
        lambda d: plain(_retried_append(d)),
        rounded("""SELECT o_orderpriority AS crop, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS rows_sum,
                          CAST(CAST(max(date_trunc('month', o_orderdate)) AS TIMESTAMP) AS VARCHAR) AS last FROM orders GROUP BY 1"""),
    ),
    "src11_retried_prediction_write": (
        lambda d: plain(_retried_predictions(d)),
        rounded("SELECT severity, count(*) AS n, sum(risk_score) AS risk, CAST(CAST(max(date_trunc('month', predicted_at)) AS TIMESTAMP) AS VARCHAR) AS last FROM predictions GROUP BY 1", "risk"),
    ),
    "src10_idempotent_feature_append": (
        lambda d: plain(_idempotent_append(d)),
        rounded("""SELECT o_custkey AS field_id, CAST(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS VARCHAR) AS computed_at, o_orderkey AS row_id, o_orderpriority AS crop
                   FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)
                        ORDER BY CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END, o_orderkey) = 1"""),
    ),
    "src13_retention_prune": (
        _pruned,
        rounded(f"""SELECT count(*) FILTER (WHERE month_at < TIMESTAMP '{NOW}' - INTERVAL 90 DAY) AS pruned,
                           count(*) FILTER (WHERE month_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY) AS kept,
                           CAST(min(month_at) FILTER (WHERE month_at >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY) AS VARCHAR) AS oldest_kept
                    FROM (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_at FROM orders)"""),
    ),
    "src18_site_sampling": (
        lambda d: plain(sample_sites(d.raw("supplier").select(F.col("s_suppkey").alias("ordinal")), d.clusters).drop("site_name")),
        rounded("""SELECT s_suppkey AS ordinal, cluster, cluster_idx,
                   round_even(lat0 + list_sum(list_transform(range(0, 38), lambda p: ((s_suppkey + 7) // CAST(pow(2, p) AS BIGINT) % 2) / pow(2e0, p + 1))) * (lat1 - lat0), 4) AS latitude,
                   round_even(lon0 + list_sum(list_transform(range(0, 38), lambda p: ((s_suppkey + 7) // CAST(pow(3, p) AS BIGINT) % 3) / pow(3e0, p + 1))) * (lon1 - lon0), 4) AS longitude
                   FROM supplier CROSS JOIN clusters""", "latitude", "longitude"),
    ),
    "src20_sites_to_reingest": (
        lambda d: plain(landed.sites_to_reingest(d.sites.select("site_id", "cluster"), d.daily_weather.filter(F.col("rain") > 25))),
        rounded("SELECT site_id, cluster FROM sites WHERE site_id NOT IN (SELECT site_id FROM daily WHERE rain > 25)"),
    ),
    "src21_json_safe_values": (
        lambda d: plain(_json_safe(d)),
        rounded("""SELECT l_linenumber, count(*) FILTER (WHERE l_tax <> 0 AND l_discount <> 0) AS n_ratio, sum(round(l_discount * 100)) AS pct_sum,
                   count(*) FILTER (WHERE l_tax <> 0 AND l_discount <> 0) AS n_pair,
                   avg(CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN round(l_discount * 100) / round(l_tax * 100) END) AS mean_ratio
                   FROM lineitem GROUP BY 1""", "pct_sum", "mean_ratio"),
    ),
    "win09_flt07_latest_fresh_features": (
        lambda d: plain(store.latest_features(_feature_log(d), _now(), ["computed_at"])),
        rounded(f"""SELECT field_id, CAST(computed_at AS VARCHAR) AS computed_at FROM
                   (SELECT o_custkey AS field_id, max(o_orderdate) AS computed_at FROM orders GROUP BY 1)
                   WHERE computed_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND TIMESTAMP '{NOW}'"""),
    ),
    "win09_src19_latest_of_buckets": (
        lambda d: plain(_latest_of_buckets(d)),
        rounded("""SELECT l.field_id, CAST(l.computed_at AS VARCHAR) AS computed_at, l.row_id, r.reports, CAST(r.last_report AS VARCHAR) AS last_report FROM (
                     SELECT o_custkey AS field_id, o_orderdate AS computed_at, o_orderkey AS row_id FROM orders
                     QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) l
                   LEFT JOIN (SELECT field_id, count(*) AS reports, max(observed_at) AS last_report FROM outcomes GROUP BY 1) r ON r.field_id = l.field_id"""),
    ),
    "join04_label_join": (
        lambda d: plain(store.label_join(d.predictions, d.outcomes)),
        rounded("""SELECT p.id, p.field_id, CAST(p.predicted_at AS VARCHAR) AS predicted_at, p.model_version, p.risk_score, p.severity,
                          o.outcome_type, CAST(o.stress_confirmed AS INTEGER) AS stress_confirmed, o.yield_t_ha, CAST(o.observed_at AS VARCHAR) AS observed_at
                   FROM predictions p JOIN outcomes o ON o.prediction_id = p.id
                   UNION ALL
                   SELECT p.id, p.field_id, CAST(p.predicted_at AS VARCHAR), p.model_version, p.risk_score, p.severity,
                          o.outcome_type, CAST(o.stress_confirmed AS INTEGER), o.yield_t_ha, CAST(o.observed_at AS VARCHAR)
                   FROM predictions p JOIN outcomes o ON o.prediction_id IS NULL AND o.field_id = p.field_id
                        AND o.observed_at BETWEEN p.predicted_at AND p.predicted_at + INTERVAL 30 DAY""", "risk_score", "yield_t_ha"),
    ),
    "agg22_label_count": (
        lambda d: store.label_count(d.predictions, d.outcomes),
        rounded("""SELECT 30 AS horizon_days, CAST(sum(n) AS BIGINT) AS labelled_pairs FROM (
                     SELECT count(*) AS n FROM predictions p JOIN outcomes o ON o.prediction_id = p.id
                     UNION ALL
                     SELECT count(*) FROM predictions p JOIN outcomes o ON o.prediction_id IS NULL AND o.field_id = p.field_id
                       AND o.observed_at BETWEEN p.predicted_at AND p.predicted_at + INTERVAL 30 DAY)"""),
    ),
    "flt10_outcome_validation": (
        lambda d: plain(d.outcomes.withColumn("valid", store.valid_outcome()).groupBy("outcome_type", "valid").agg(
            F.count(F.lit(1)).alias("n"), F.max("yield_t_ha").alias("max_yield"))),
        rounded("""SELECT outcome_type, CAST(yield_t_ha IS NULL OR yield_t_ha BETWEEN 0 AND 30 AS INTEGER) AS valid, count(*) AS n, max(yield_t_ha) AS max_yield
                   FROM outcomes GROUP BY 1, 2""", "max_yield"),
    ),
}
