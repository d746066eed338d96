"""Session defaults for local runs, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "cropspark") -> SparkSession:
    """Session for tests and the benchmark. On a cluster the submitted configuration is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by the cluster.

    Where none is named, a local session gets a scratch folder that is removed when the process ends; a cluster session is
    refused, since each executor would write into its own disk and reads would miss rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_scratch()


@functools.cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="cropspark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def run_folder(spark: SparkSession) -> str:
    """One folder for this application's intermediate tables, removed when the application ends."""
    path = f"{shared_folder(spark)}/cropspark-{spark.sparkContext.applicationId}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(target):
        system.mkdirs(target)
        system.deleteOnExit(target)
    return path


def cut_path(spark: SparkSession) -> str:
    """A new path for rows that are written in between."""
    return f"{run_folder(spark)}/cuts/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write the rows below the shared folder and read them back.

    Later steps start from the files, so a lost executor costs a re-read and not a recomputation, and
    the planner sees real sizes. One pass, where a checkpoint would compute the rows twice.
    """
    path = path or cut_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_cut(spark: SparkSession, path: str) -> None:
    """Delete rows written in between, once nothing reads them any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
