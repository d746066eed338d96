"""Running a stream over the data that is available now."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cropspark.session import run_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; sinks and stream checkpoints live there."""
    return f"{run_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet file set as a stream; the schema is taken from the files' footers when not given."""
    path = f"{folder}/{table}.parquet"
    schema = schema or spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A join of two streams keeps all its tables in one store, and a batch writes what it changed instead of the whole store. A row
#: is put without a look whether it is there already (that only counts the rows). An inner join gives out nothing in a batch without
#: data, so rows past the watermark wait for the next batch that has some instead of being deleted one by one at the end.
JOIN_STATE = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which state with maps and timers needs."""
    return _settings(spark, {PROVIDER: ROCKSDB})


def join_state(spark: SparkSession):
    """Streams started inside keep the rows of their joins in RocksDB, so a batch may be larger than the heap."""
    return _settings(spark, JOIN_STATE)


def run_to_files(stream: DataFrame, name: str, folder: str | None = None) -> str:
    """Append the stream's result to parquet until the available input is used up; returns the folder."""
    root = folder or scratch(stream.sparkSession, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{root}/out"


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str) -> str:
    root = scratch(stream.sparkSession, name)
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return root
