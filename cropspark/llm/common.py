"""Shared helpers: the cluster's shared folder, written intermediate tables, labelled texts, and ASCII lower-casing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor sees, from spark.checkpoint.dir.

    Where it is unset, a local session gets a scratch folder of its own; a cluster session is refused, since an
    executor's own disk would be read back incompletely.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed by the driver when the application ends."""
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(jvm_path)
    system.deleteOnExit(jvm_path)
    return path


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder made by new_folder, once nothing reads its tables any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(df: DataFrame, name: str, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """The rows as a written table: later steps survive lost executors without recomputing, and see real sizes.

    Tables of one operator call share its folder, so that they can be removed together. The shuffle files behind the rows are
    let go at once: Spark deletes them when the driver collects its garbage, which a large heap may put off for the whole job.
    """
    path = f"{folder or new_folder(df.sparkSession, name)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    spark, schema = df.sparkSession, df.schema
    del df
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text, modulo the number of folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, folder: str, per_class: int | None = None) -> DataFrame:
    """(text, y, part) of every labelled text, written once below the folder; part is a hash of the id modulo 6.

    docs has doc_id and text, labels has doc_id and the label column; `keep` is a condition on doc_id. Null ids, labels
    other than 0 and 1, and null texts are left out. With `per_class`, only that many ids of either class, chosen by their hash.
    """
    chosen = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    if per_class is not None:
        ordered = [chosen.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
        chosen = ordered[0].unionByName(ordered[1])
    rows = docs.where(keep & F.col("text").isNotNull()).select("doc_id", "text").join(chosen.hint("merge"), "doc_id")
    return written(rows.select("text", "y", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(6)).cast("int").alias("part")), "labelled", folder, codec="zstd")


def class_counts(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> tuple[int, int]:
    """Number of labelled texts of class 0 and 1, by the conditions of labelled_rows and without its bound."""
    chosen = labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y")).distinct()
    found = docs.where(F.col("text").isNotNull()).select("doc_id").join(chosen, "doc_id").groupBy("y").count().collect()
    counts = {int(r["y"]): int(r["count"]) for r in found}
    return counts.get(0, 0), counts.get(1, 0)


def to_true_odds(weights: np.ndarray, sampled: tuple[int, int], counts: tuple[int, int] | None) -> np.ndarray:
    """The weights with the intercept moved from the odds of the sampled rows to those of all labelled rows."""
    if counts and min(*sampled, *counts) > 0:
        weights = weights.copy()
        weights[0] += np.log(counts[1] / counts[0]) - np.log(sampled[1] / sampled[0])
    return weights


def _newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The rows' share of the Hessian and, as its last row, of the gradient."""
    x = np.column_stack([np.ones(len(x)), x])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.vstack([(x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p)])


def _newton(sums_at: Callable[[np.ndarray], np.ndarray], counts: tuple[float, float], width: int, ridge: float, rounds: int) -> np.ndarray:
    w = np.zeros(1 + width)
    if min(counts) == 0:
        w[0] = np.log((counts[1] + 1) / (counts[0] + 1))
        return w
    penalty = np.full(1 + width, ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        sums = sums_at(w)
        step = np.linalg.solve(sums[:-1] + np.diag(penalty), sums[-1] - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps of a ridge logistic regression; the first weight is the intercept. Without rows of both classes: the prior."""
    width = x.shape[1] if x.ndim == 2 else 0
    return _newton(lambda w: _newton_sums(x, y, w), (len(y) - y.sum(), y.sum()) if len(y) else (0, 0), width, ridge, rounds)


def fit_logistic_rows(rows: DataFrame, width: int, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """fit_logistic on a written table (x array<double>, y int): every step adds up its sums over all rows in the tasks."""
    spark = rows.sparkSession
    ship(spark)
    found = {int(r["y"]): int(r["count"]) for r in rows.groupBy("y").count().collect()}

    def sums_at(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width + 2, width + 1))
            for batch in batches:
                if len(batch):
                    total += _newton_sums(np.vstack(batch["x"].to_numpy()), batch["y"].to_numpy(dtype=float), w)
            yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

        out = np.zeros((width + 2) * (width + 1))
        for r in rows.mapInPandas(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
            out[r["cell"]] = r["value"]
        return out.reshape(width + 2, width + 1)

    return _newton(sums_at, (found.get(0, 0), found.get(1, 0)), width, ridge, rounds)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


BUCKETS = 1 << 20


def in_marked_buckets(rows: DataFrame, row_key: Column, keys: DataFrame, key: Column, inside: bool = True) -> DataFrame:
    """Rows whose key's hash bucket holds one of the keys (or holds none of them).

    A first sieve before a join by key: at most BUCKETS numbers are broadcast, whatever the tables hold. Rows inside are not
    yet those with a key of their own, so the join itself still follows; rows outside surely have none.
    """
    marked = keys.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("__bucket")).distinct()
    own = rows.withColumn("__bucket", F.pmod(F.xxhash64(row_key), F.lit(BUCKETS)))
    return own.join(F.broadcast(marked), "__bucket", "left_semi" if inside else "left_anti").drop("__bucket")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installed copy of it."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), f"{package}-llm.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    target.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._llm_shipped = True


def broadcast(spark: SparkSession, value):
    """Broadcast of a fitted model, whose size its own parameters bound."""
    ship(spark)
    return spark.sparkContext.broadcast(value)
