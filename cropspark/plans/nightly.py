"""The nightly job over all registered fields, and the choice between its stored rows and fresh computation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.plans.features import failed_fields, field_features, run_summary, to_store_rows
from cropspark.schemas import FIELD_FEATURES
from cropspark.session import cut_lineage
from cropspark.sources import store

STORED = "precomputed"
LIVE = "live"


def nightly(fields: DataFrame, state: DataFrame, root: str, now: dt.datetime) -> DataFrame:
    """Compute and store every field's row, keep the refused fields with their reasons, prune, and sum up.

    Rows go to field_features, refused fields to rejects beside it; one row of counts comes back.
    """
    spark = fields.sparkSession
    rows = cut_lineage(field_features(fields, state))
    failed = cut_lineage(failed_fields(fields, state))
    store.create_empty(spark, root, "field_features")
    store.write_features(to_store_rows(rows, F.lit(now).cast("timestamp_ntz")), root, f"nightly-{now:%Y%m%dT%H%M%S%f}")
    failed.withColumn("run_at", F.lit(now).cast("timestamp_ntz")).write.mode("append").parquet(f"{root}/rejects")
    return run_summary(rows, failed, store.prune_features(spark, root, now))


def stored_or_computed(fields: DataFrame, state: DataFrame, root: str, now: dt.datetime) -> DataFrame:
    """A row for every field: the stored one where it is fresh, else computed now; feature_source tells which.

    Only fields without a fresh row reach the computation.
    """
    at = F.lit(now).cast("timestamp_ntz")
    shape = ["field_id", "crop", "features", "context"]
    fresh = store.latest_features(store.read(fields.sparkSession, root, "field_features"), at)
    missing = fields.join(fresh.select("field_id"), "field_id", "left_anti")
    computed = to_store_rows(field_features(missing, state), at)
    computed = computed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FIELD_FEATURES.fields])
    known = fresh.join(fields.select("field_id"), "field_id", "left_semi")
    return known.select(*shape, F.lit(STORED).alias("feature_source")).unionByName(
        computed.select(*shape, F.lit(LIVE).alias("feature_source"))
    )
