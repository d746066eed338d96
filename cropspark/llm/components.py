"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(u, v): the smallest number v that each u is connected with; a number without edges, or the smallest itself, has no row.

    edges has whole numbers u and v in either order. A number with many edges is met by map-side minima and a join that can be
    split, and each round is a written table. Rounds end when a round changes nothing.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.written(edges, "edges", folder)
    state = _state(edges)
    while True:
        edges = common.written(_small_star(_large_star(edges).distinct()).distinct(), "edges", folder)
        now = _state(edges)
        if now == state:
            return edges
        state = now


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
