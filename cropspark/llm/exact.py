"""Exact deduplication as a stateful stream, in DataFrame operations only.

Digest, stable identifier and content locator (file and row) of each row are appended to a narrow arrivals table, which is read
as a stream. Keyed state on disk (RocksDB, checkpointed to the shared folder) holds, without expiry, one entry for each digest
of the normalised text: how many rows had it, and identifier and locator of the row that stays. Partial aggregates run before
the shuffle, so a text that a third of all rows share arrives as one entry from each task. The state outlives the run: with the
same arrivals and state folders, a later run takes up new rows only.

The digest decides nothing alone. For every digest that was hit, the whole normalised texts of its rows are fetched by locator
and compared byte by byte; equal ones collapse in each task before they are shuffled. If different texts share a digest, the
rows of that digest are grouped by their whole text instead.

Null texts count as empty and are equal to each other. The row with the largest id stays; a null id is smaller than any other;
among rows with the same id the one with the largest locator stays. Exactly one row of a group stays, also if rows repeat in
full. An empty table gives an empty result. Columns besides id and text pass unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cropspark.llm import common

STATE_OPTIONS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # a store is opened for its commit and closed again, and reserves no disk ahead of what it holds
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def _located(rows: DataFrame, id: str, text: str) -> DataFrame:
    """Entry (identifier and locator) and normalised text of each row of a file-based table."""
    entry = F.struct(F.col(id).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select(entry.alias("entry"), common.ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("body"))


def _session(spark: SparkSession) -> SparkSession:
    session = spark.newSession()
    for name, value in STATE_OPTIONS.items():
        session.conf.set(name, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return session


def take_up(spark: SparkSession, arrivals: str, state: str) -> None:
    """Take the rows of the arrivals table that the state has not seen into the keyed state."""
    session = _session(spark)
    seen = session.readStream.schema(spark.read.parquet(arrivals).schema).parquet(arrivals)
    entries = seen.groupBy("digest").agg(F.count("*").alias("n"), F.max("entry").alias("keep"))
    query = entries.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def read_state(spark: SparkSession, state: str, folder: str | None = None) -> DataFrame:
    """(digest, n, keep) of every entry of the keyed state, as a written table."""
    rows = _session(spark).read.format("statestore").load(state)
    return common.written(rows.select(F.col("key.digest").alias("digest"), "value.*").toDF("digest", "n", "keep"), "exact-state", folder)


def file_based(docs: DataFrame) -> DataFrame:
    """The table itself if its rows carry a file and a row number, else a written copy of it."""
    try:
        if "_metadata" not in docs.columns:
            docs.select("_metadata.file_path", "_metadata.row_index")
            return docs
    except AnalysisException:
        pass
    clear = docs.withColumnRenamed("_metadata", "__own_metadata") if "_metadata" in docs.columns else docs
    return common.written(clear, "exact-rows")


def classify(
    docs: DataFrame, id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256, folder: str | None = None
) -> DataFrame:
    """One row for each row of `docs` (see `file_based`): entry (id, file, row), digest, keep (the entry that stays), n (group size)."""
    spark = docs.sparkSession
    rows = _located(docs, id, text)
    folder = folder or common.new_folder(spark, "exact")
    arrivals = f"{folder}/arrivals"
    rows.select(digest(F.col("body")).alias("digest"), "entry").write.mode("append").parquet(arrivals)
    keyed = spark.read.parquet(arrivals)
    if keyed.isEmpty():
        return keyed.select("entry", "digest", F.col("entry").alias("keep"), F.lit(1).cast("long").alias("n"))
    take_up(spark, arrivals, f"{folder}/state")
    placed = keyed.join(read_state(spark, f"{folder}/state", folder), "digest").select("entry", "digest", "keep", "n")

    hits = placed.where("n > 1")
    entry_key = F.struct("entry.file", "entry.row")
    fetched = common.in_marked_buckets(rows, entry_key, hits, entry_key).select(digest(F.col("body")).alias("digest"), "body", "entry")
    unequal = fetched.select("digest", "body").distinct().groupBy("digest").count().where("count > 1").select("digest")
    unequal = common.written(unequal, "exact-unequal", folder)
    if unequal.isEmpty():
        return placed
    apart = fetched.join(unequal, "digest", "left_semi")
    by_text = apart.groupBy("digest", "body").agg(F.max("entry").alias("keep"), F.count("*").alias("n"))
    regrouped = apart.join(by_text, ["digest", "body"]).select("entry", "digest", "keep", "n")
    return placed.join(unequal, "digest", "left_anti").select("entry", "digest", "keep", "n").unionByName(regrouped)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    Only rows whose hash bucket holds a dropped row go through the join; the others pass without a shuffle.
    """
    docs = file_based(docs)
    folder = common.new_folder(docs.sparkSession, "exact-keep")
    dropped = classify(docs, id, text, folder=folder).where(F.col("entry") != F.col("keep")).select("entry.file", "entry.row")
    dropped = common.written(dropped, "exact-dropped").toDF("__file", "__row")
    common.remove(docs.sparkSession, folder)
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    key = F.struct("__file", "__row")
    outside = common.in_marked_buckets(rows, key, dropped, key, inside=False)
    inside = common.in_marked_buckets(rows, key, dropped, key).join(dropped, ["__file", "__row"], "left_anti")
    out = outside.select("__doc.*").unionByName(inside.select("__doc.*"))
    return out.withColumnRenamed("__own_metadata", "_metadata")
