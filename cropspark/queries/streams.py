"""Streaming jobs over the table files, each comparable with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from cropspark.queries.flatten import plain
from cropspark.queries.oracle import dsv, rounded
from cropspark.streaming import outcomes as SO
from cropspark.streaming import wetness as SW
from cropspark.streaming.runs import file_stream, join_state, rocksdb_state, run_to_files


def _readings(d):
    events = file_stream(d.spark, d.folder, "events")
    return events.select(
        F.col("event_type").alias("site_id"), F.col("ts").cast("timestamp").alias("ts"), (F.lit(5.0) + F.col("value") % 25).alias("temp"),
        (F.lit(80.0) + F.floor("value") % 21).alias("rh"), (F.col("value") > 150).alias("sprayed"),
    )


def _daily(d):
    return run_to_files(SW.daily_wetness(_readings(d)), "wetness")


_DAILY_SQL = f"""SELECT site_id, day, wet_hours, wet_temp, {dsv('wet_temp', 'wet_hours')} AS severity, sprayed FROM (
  SELECT event_type AS site_id, CAST(ts AS DATE) AS day, CAST(count(CASE WHEN 80 + floor(value) % 21 >= 90 THEN 1 END) AS INTEGER) AS wet_hours,
         coalesce(avg(CASE WHEN 80 + floor(value) % 21 >= 90 THEN 5e0 + value % 25 END), avg(5e0 + value % 25)) AS wet_temp, max(value) > 150 AS sprayed
  FROM events GROUP BY 1, 2)
  WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 6 HOUR FROM events)"""


#: Bytes of daily rows in a micro-batch.
SINCE_SPRAY_BATCH = 64 << 20


def _since_spray(d):
    source = _daily(d)
    # a batch takes files by their size: one of some fixed number would make as many batches as the daily job had tasks
    days = d.spark.readStream.schema(d.spark.read.parquet(source).schema).option("maxBytesPerTrigger", SINCE_SPRAY_BATCH).parquet(source)
    with rocksdb_state(d.spark):
        out = run_to_files(SW.severity_since_spray(days), "spray")
    return SW.latest_revision(d.spark.read.parquet(out))


def _outcome_stream(d):
    lines = file_stream(d.spark, d.folder, "lineitem")
    orders = d.raw("orders").select("o_orderkey", "o_custkey")
    flag = F.col("l_returnflag")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("prediction_id"), F.col("o_custkey").alias("field_id"),
        F.col("l_shipdate").cast("timestamp").alias("observed_at"),
        F.when(flag == "A", "agent_visit").when(flag == "N", "diagnosis").otherwise("harvest").alias("outcome_type"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("yield_t_ha"),
    )


def _links(d):
    orders = file_stream(d.spark, d.folder, "orders")
    predictions = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("field_id"), F.col("o_orderdate").cast("timestamp").alias("predicted_at")
    )
    outcomes = _outcome_stream(d)
    stored = d.predictions.select("id", "field_id", F.col("predicted_at").cast("timestamp").alias("predicted_at"))
    with join_state(d.spark):  # the files may come as one batch, all of whose rows are state until it ends
        by_time = d.spark.read.parquet(run_to_files(SO.link_in_horizon(predictions, outcomes), "links"))
    by_id = d.spark.read.parquet(run_to_files(SO.link_by_id(outcomes, stored), "links"))
    both = by_time.unionByName(by_id)
    return both.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("predicted_at", "observed_at")})


def _capture(d):
    good, refused = SO.capture(_outcome_stream(d))
    read = d.spark.read
    rows = read.parquet(good).withColumn("accepted", F.lit(True)).unionByName(read.parquet(refused).withColumn("accepted", F.lit(False)))
    return rows.groupBy("outcome_type", "accepted").agg(F.count(F.lit(1)).alias("n"), F.max("yield_t_ha").alias("max_yield"))


QUERIES = {
    "str01_daily_wetness_stream": (
        lambda d: plain(d.spark.read.parquet(_daily(d))),
        rounded(f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day, CAST(sprayed AS INTEGER) AS sprayed) FROM ({_DAILY_SQL})", "wet_temp"),
    ),
    "str02_outcome_links_stream": (
        lambda d: plain(_links(d)),
        rounded("""SELECT p.id, p.field_id, CAST(p.predicted_at AS VARCHAR) AS predicted_at, o.outcome_type, CAST(o.observed_at AS VARCHAR) AS observed_at
                   FROM predictions p JOIN outcomes o ON o.prediction_id = p.id
                   UNION ALL SELECT p.id, p.field_id, CAST(p.predicted_at AS VARCHAR), o.outcome_type, CAST(o.observed_at AS VARCHAR)
                   FROM predictions p JOIN outcomes o ON o.prediction_id IS NULL AND o.field_id = p.field_id
                     AND o.observed_at BETWEEN p.predicted_at AND p.predicted_at + INTERVAL 30 DAY"""),
    ),
    "str03_severity_since_spray_stream": (
        lambda d: plain(_since_spray(d)),
        rounded(f"""SELECT site_id, CAST(day AS VARCHAR) AS day, severity, CAST(total AS BIGINT) AS total, CAST(total >= 18 AS INTEGER) AS spray_due FROM (
                    SELECT *, sum(severity) OVER (PARTITION BY site_id, run ORDER BY day) AS total FROM (
                    SELECT *, sum(CASE WHEN sprayed THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY day) AS run FROM ({_DAILY_SQL})))"""),
    ),
    "str04_outcome_capture_stream": (
        lambda d: plain(_capture(d)),
        rounded("""SELECT outcome_type, CAST(yield_t_ha IS NULL OR yield_t_ha BETWEEN 0 AND 30 AS INTEGER) AS accepted, count(*) AS n, max(yield_t_ha) AS max_yield
                   FROM outcomes GROUP BY 1, 2""", "max_yield"),
    ),
}
