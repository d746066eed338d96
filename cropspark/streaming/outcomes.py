"""Linking outcomes to predictions as they arrive, and capturing outcome reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.constants import LABEL_HORIZON_DAYS
from cropspark.sources.store import split_outcomes
from cropspark.streaming.runs import run_batches, scratch

FACTS = ["outcome_type", "observed_at"]


def link_in_horizon(
    predictions: DataFrame, outcomes: DataFrame, horizon_days: int = LABEL_HORIZON_DAYS, lateness: str = "1 day"
) -> DataFrame:
    """Unlinked outcomes joined to the predictions of their field in the horizon before them.

    Both sides carry a watermark and the time bounds limit the state: a prediction is kept for one
    horizon, an outcome only for the lateness. Both are hashed by field and by a time bucket of the
    horizon, so a busy field is spread over its buckets. A prediction stands in the two buckets it
    reaches, since there are more outcomes than predictions and every row of either is kept as state.
    """
    micros = horizon_days * 86_400 * 1_000_000

    def bucket(c: str):
        return F.floor(F.unix_micros(F.col(c)) / F.lit(micros)).cast("long")

    p = predictions.withWatermark("predicted_at", lateness).select(
        "id", F.col("field_id").alias("p_field"), "predicted_at",
        F.explode(F.array(bucket("predicted_at"), bucket("predicted_at") + 1)).alias("p_bucket"),
    )
    o = (
        outcomes.filter(F.col("prediction_id").isNull())
        .withWatermark("observed_at", lateness)
        .select("field_id", *FACTS, bucket("observed_at").alias("o_bucket"))
    )
    in_time = (F.col("observed_at") >= F.col("predicted_at")) & (
        F.col("observed_at") <= F.col("predicted_at") + F.expr(f"interval {horizon_days} days")
    )
    same = (F.col("p_field") == F.col("field_id")) & (F.col("p_bucket") == F.col("o_bucket"))
    return p.join(o, same & in_time).select("id", "field_id", "predicted_at", *FACTS)


def link_by_id(outcomes: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcomes that name a prediction, against the stored predictions (a table, not a stream)."""
    linked = outcomes.filter(F.col("prediction_id").isNotNull()).select(F.col("prediction_id").alias("id"), *FACTS)
    return linked.join(stored.select("id", "field_id", "predicted_at"), "id").select("id", "field_id", "predicted_at", *FACTS)


def capture(outcomes: DataFrame, folder: str | None = None) -> tuple[str, str]:
    """Validate arriving reports and append them; refused ones go to a side folder.

    Every micro-batch owns a directory that a retry overwrites, so a batch is stored once.
    """
    root = folder or scratch(outcomes.sparkSession, "capture")
    good, refused = f"{root}/accepted", f"{root}/refused"

    def handle(batch: DataFrame, batch_id: int) -> None:
        accepted, rest = split_outcomes(batch)
        accepted.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        rest.write.mode("overwrite").parquet(f"{refused}/batch={batch_id}")

    run_batches(outcomes, handle, "capture")
    return good, refused
