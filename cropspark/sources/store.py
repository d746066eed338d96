"""Append-only store of features, predictions and outcomes as parquet partitioned by day."""

from __future__ import annotations

import datetime as dt
import json
import logging
import uuid
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cropspark.constants import FRESH_HOURS, KEEP_DAYS, LABEL_HORIZON_DAYS, OUTCOME_TYPES, YIELD_BOUNDS
from cropspark.functions.numeric import finite_or_null
from cropspark.operators.lookup import interval_join, join_reference, latest_by
from cropspark.schemas import STORE_TABLES
from cropspark.session import cut_lineage

TIME_COLUMN = {"field_features": "computed_at", "predictions": "predicted_at", "field_outcomes": "recorded_at"}
log = logging.getLogger(__name__)


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _partitioned(table: str) -> T.StructType:
    return T.StructType([*STORE_TABLES[table].fields, T.StructField("day", T.DateType())])


def ensure_schema(spark: SparkSession, root: str) -> None:
    """Create the three tables where they do not exist yet; safe to repeat."""
    for name in STORE_TABLES:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _partitioned(name).fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (day) "
            f"LOCATION '{_path(root, name)}'"
        )


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All committed rows of a table."""
    recover(spark, root, table)
    return spark.read.schema(_partitioned(table)).parquet(_path(root, table))


def _declared(spark: SparkSession, root: str, table: str) -> bool:
    """Whether the session's catalogue declares the table over this very store."""
    if not spark.catalog.tableExists(table):
        return False
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter(F.col("col_name") == "Location").collect()
    return any(r["data_type"].split(":", 1)[-1].lstrip("/") == _path(root, table).split(":", 1)[-1].lstrip("/") for r in rows)


def append(rows: DataFrame, root: str, table: str, batch: str | None = None) -> int:
    """Append rows as one batch, whole or not at all; returns how many. The partition day comes from the table's time column.

    The rows are written to a staging folder that readers do not see. One rename of the batch's manifest commits them, and the files
    then move to their days. A run that dies before the rename leaves nothing; one that dies after it is finished by whoever
    reads or appends next (``recover``). A batch that is committed already adds nothing, so a run may be repeated under its name.
    Moved days are taken up by a declared table's catalogue, so readers by name see them. Before the write the rows are brought
    together by day, large days split at run time: a batch then has about as many files as days, not as days times tasks, and the
    driver's lists of files and the moves grow with the days only.
    """
    spark = rows.sparkSession
    batch = batch or uuid.uuid4().hex
    files = _Files(spark, _path(root, table))
    create_empty(spark, root, table)
    recover(spark, root, table)
    if files.exists(f"{COMMITS}/{batch}"):
        return 0
    names = STORE_TABLES[table].fieldNames()
    written = Observation()
    attempt = f"{STAGING}/{batch}-{uuid.uuid4().hex}"
    dealt = rows.select(*names).withColumn("day", F.to_date(TIME_COLUMN[table])).hint("rebalance", F.col("day"))
    ready = dealt.observe(written, F.count(F.lit(1)).alias("n"))  # above the exchange, which an empty batch does away with
    ready.write.partitionBy("day").parquet(files.at(attempt))
    n = written.get["n"]
    if not _commit(files, batch, attempt, n):
        files.delete(attempt)
        return 0
    _publish(spark, files, root, table, batch)
    return n


STAGING, COMMITS = "_staging", "_commits"


class _Files:
    """Files below one table's folder, on whatever file system it lies."""

    def __init__(self, spark: SparkSession, base: str):
        self._jvm, self.base = spark._jvm, base
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._system = self._path("").getFileSystem(self._conf)

    def at(self, name: str) -> str:
        return f"{self.base}/{name}" if name else self.base

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def exists(self, name: str) -> bool:
        return self._system.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(f.getPath().getName() for f in self._system.listStatus(self._path(name))) if self.exists(name) else []

    def read(self, name: str) -> str:
        stream = self._system.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._system.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, name: str) -> None:
        self._system.delete(self._path(name), True)

    def make(self, name: str) -> None:
        self._system.mkdirs(self._path(name))

    @cached_property
    def _renames(self):
        fs = self._jvm.org.apache.hadoop.fs
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").NONE
        return fs.FileContext.getFileContext(self._system.getUri(), self._conf), options

    def move(self, source: str, target: str) -> bool:
        """Rename in one step; False where the target is there already."""
        context, options = self._renames
        try:
            context.rename(self._path(source), self._path(target), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True


def _commit(files: _Files, batch: str, attempt: str, n: int) -> bool:
    """The one step that makes a batch count: its manifest takes its name. False if another run of the batch was first."""
    files.make(COMMITS)
    draft = f"{COMMITS}/.{attempt.rsplit('/', 1)[1]}"
    files.write(draft, json.dumps({"attempt": attempt, "rows": n}))
    if files.move(draft, f"{COMMITS}/{batch}"):
        return True
    files.delete(draft)
    return False


def _publish(spark: SparkSession, files: _Files, root: str, table: str, batch: str) -> None:
    """Move a committed batch's files to their days; what an earlier run has moved is not met again."""
    attempt = json.loads(files.read(f"{COMMITS}/{batch}"))["attempt"]
    days = [d for d in files.names(attempt) if d.startswith("day=")]
    for day in days:
        if not files.move(f"{attempt}/{day}", day):  # a new day moves as a folder, a known one file by file
            for name in files.names(f"{attempt}/{day}"):
                files.move(f"{attempt}/{day}/{name}", f"{day}/{name}")
    if days and _declared(spark, root, table):
        spec = [d.removeprefix("day=") for d in days]
        parts = " ".join("PARTITION (day = NULL)" if d == "__HIVE_DEFAULT_PARTITION__" else f"PARTITION (day = DATE '{d}')" for d in spec)
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
        spark.catalog.refreshTable(table)
    files.delete(attempt)


def recover(spark: SparkSession, root: str, table: str) -> None:
    """Finish the moves of batches that were committed by a run that did not come to its end."""
    files = _Files(spark, _path(root, table))
    for name in files.names(STAGING):
        batch = name.rsplit("-", 1)[0]
        if files.exists(f"{COMMITS}/{batch}") and json.loads(files.read(f"{COMMITS}/{batch}"))["attempt"] == f"{STAGING}/{name}":
            _publish(spark, files, root, table, batch)


def create_empty(spark: SparkSession, root: str, table: str) -> None:
    """Make the store readable before its first row; does nothing where it exists."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_path(root, table))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        system.mkdirs(path)


def by_field(rows: DataFrame, name: str, path: str, buckets: int | None = None) -> DataFrame:
    """The rows as a catalogue table in buckets of the field, each sorted by it; an older table of the name is replaced.

    A rewrite of the store for its readers: the latest row of each field, and joins on the field with another table in as many
    buckets, then need no shuffle of the stored side. There are as many buckets as shuffle partitions unless told otherwise.
    """
    spark = rows.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # one task a bucket writes one file a bucket, so the order inside it holds
    dealt = rows.repartition(buckets, "field_id").sortWithinPartitions("field_id")
    dealt.write.format("parquet").bucketBy(buckets, "field_id").sortBy("field_id").option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def json_safe(value: Column, dtype: T.DataType) -> Column:
    """NaN and infinities become NULL, at any depth."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite_or_null(value)
    if isinstance(dtype, T.StructType):
        cleaned = F.struct(*[json_safe(value[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(value.isNotNull(), cleaned)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: json_safe(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, x: json_safe(x, dtype.valueType))
    return value


def clean(rows: DataFrame) -> DataFrame:
    return rows.select(*[json_safe(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields])


def new_rows(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet, one per key (the first by ``order``).

    Both sides grow with the rows. The stored keys are a small share of a stored row, so by the planner's estimate they would go
    through the driver to every task.
    """
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    return first.join(existing.select(*keys).hint("merge"), keys, "left_anti").select(*batch.columns)


def write_features(batch: DataFrame, root: str, name: str | None = None) -> int:
    """Idempotent on (field_id, computed_at); only the days of the batch are read back. Returns the rows added."""
    spark = batch.sparkSession
    stored = read(spark, root, "field_features")
    days = batch.select(F.to_date("computed_at").alias("day")).distinct()
    same_days = join_reference(stored, days, ["day"], "left_semi")
    fresh = new_rows(same_days, batch, ["field_id", "computed_at"], ["latitude", "longitude"])
    return append(clean(fresh), root, "field_features", name)


def write_predictions(rows: DataFrame, root: str, name: str | None = None) -> DataFrame | None:
    """Append and hand the ids back for linking; a failing audit table must not fail the scoring."""
    try:
        append(clean(rows), root, "predictions", name)
    except (PySparkException, Py4JJavaError) as e:  # a failed write comes back as either
        log.warning("predictions not persisted: %s", e)
        return None
    return rows.select("id", "field_id", "predicted_at")


def valid_outcome() -> Column:
    low, high = YIELD_BOUNDS
    known = F.coalesce(F.col("outcome_type").isin(OUTCOME_TYPES), F.lit(False))
    amount = F.col("yield_t_ha").isNull() | F.col("yield_t_ha").between(low, high)
    return F.col("field_id").isNotNull() & F.col("observed_at").isNotNull() & known & amount


def split_outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid reports and refused ones."""
    return rows.filter(valid_outcome()), rows.filter(~valid_outcome())


def write_outcomes(rows: DataFrame, root: str, name: str | None = None) -> DataFrame:
    """Append the valid reports and return the refused ones."""
    good, refused = split_outcomes(rows)
    append(clean(good), root, "field_outcomes", name)
    return refused


def is_fresh(computed_at: Column, now: Column, hours: int = FRESH_HOURS) -> Column:
    """Both ends count as fresh; a row from the future does not."""
    return F.coalesce(computed_at.between(now - F.make_dt_interval(hours=F.lit(hours)), now), F.lit(False))


def latest_features(rows: DataFrame, now: Column, keep: list[str] | None = None) -> DataFrame:
    """Latest row per field, and only if that one is fresh."""
    keep = keep or [c for c in rows.columns if c != "field_id"]
    return latest_by(rows, ["field_id"], ["computed_at"], keep).filter(is_fresh(F.col("computed_at"), now))


def expired(computed_at: Column, now: Column, keep_days: int = KEEP_DAYS) -> Column:
    return computed_at < now - F.make_dt_interval(F.lit(keep_days))


def prune_features(spark: SparkSession, root: str, now: dt.datetime, keep_days: int = KEEP_DAYS) -> int:
    """Drop feature rows older than ``keep_days`` and report how many.

    Days entirely past the limit are removed as directories; only the day of the limit is rewritten.
    """
    limit = now - dt.timedelta(days=keep_days)
    stored = read(spark, root, "field_features")
    path = _path(root, "field_features")
    # whole days are counted from the files' footers; the day of the limit is counted by the pass that rewrites it
    whole = {r["day"]: r["n"] for r in stored.filter(F.col("day") < F.lit(limit.date())).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = Observation()
    counts = [F.count_if(F.col("computed_at") < F.lit(limit)).alias("old"), F.count(F.lit(1)).alias("all")]
    of_limit = stored.filter(F.col("day") == F.lit(limit.date())).observe(seen, *counts)
    kept = cut_lineage(of_limit.filter(~(F.col("computed_at") < F.lit(limit))))
    old = seen.get["old"]
    if old and old == seen.get["all"]:
        _drop_day(spark, root, "field_features", limit.date())
    elif old:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for day in whole:
        _drop_day(spark, root, "field_features", day)
    if _declared(spark, root, "field_features"):
        spark.catalog.refreshTable("field_features")
    return sum(whole.values()) + old


def _drop_day(spark: SparkSession, root: str, table: str, day: dt.date) -> None:
    """The day leaves the catalogue first, so readers by name never meet half a day; the files of an external table follow."""
    if _declared(spark, root, table):
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (day = DATE '{day}')")
    _remove(spark, f"{_path(root, table)}/day={day}")


def _remove(spark: SparkSession, directory: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(directory)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def label_join(predictions: DataFrame, outcomes: DataFrame, horizon_days: int = LABEL_HORIZON_DAYS) -> DataFrame:
    """Predictions with the outcomes that followed them.

    An explicit link always counts; a report without one counts for the predictions of its field in
    the horizon before it. The two cases exclude each other, so they are two equi joins and a union.
    """
    facts = ["outcome_type", "stress_confirmed", "diagnosis", "yield_t_ha", "observed_at"]
    facts = [c for c in facts if c in outcomes.columns]
    linked = outcomes.filter(F.col("prediction_id").isNotNull()).select(F.col("prediction_id").alias("id"), *facts)
    free = outcomes.filter(F.col("prediction_id").isNull()).select("field_id", *facts)
    by_id = predictions.join(linked, "id")
    by_time = interval_join(predictions, free, "field_id", "predicted_at", "observed_at", horizon_days)
    columns = [*predictions.columns, *facts]
    return by_id.select(*columns).unionByName(by_time.select(*columns))


def label_count(predictions: DataFrame, outcomes: DataFrame, horizon_days: int = LABEL_HORIZON_DAYS) -> DataFrame:
    pairs = label_join(predictions.select("id", "field_id", "predicted_at"), outcomes, horizon_days)
    return pairs.agg(F.lit(horizon_days).alias("horizon_days"), F.count(F.lit(1)).alias("labelled_pairs"))
