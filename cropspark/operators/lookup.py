"""Lookups and joins whose physical strategy matters at scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_reference(df: DataFrame, ref: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a reference table that has one row per key.

    Without a hint: the planner broadcasts a side whose measured size is small enough, and otherwise shuffles by key and splits
    skewed partitions at run time.
    """
    return df.join(ref, on, how)


#: Rows up to which a table with a known bound is sent to every task.
SENT_ROWS = 100_000


def join_bounded(df: DataFrame, ref: DataFrame, on: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join a reference table that has one row per key and at most ``rows`` in all.

    The planner knows written rows by the size of their compressed files, and an aggregate over a join by the product of its
    sides: left to itself it may send the rows to the few keys.
    """
    return df.join(F.broadcast(ref) if rows <= SENT_ROWS else ref, on, how)


def latest_by(df: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per key with the largest ``order`` tuple; NULL sorts lowest.

    An aggregate, not a ranking window: partial maxima are taken before the shuffle, so a key that
    holds a large share of the rows reaches the reducers as a few partial rows.
    """
    pick = F.max_by(F.struct(*keep), F.struct(*order)).alias("_latest")
    return df.groupBy(*keys).agg(pick).select(*keys, "_latest.*")


def nearest_date_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_date: str,
    right_date: str,
    tolerance_days: int,
    match: str = "matched",
) -> DataFrame:
    """Left join each row to the closest dated row of the same key, at most ``tolerance_days`` away.

    Ties go to the earlier date. Dates fall into bins one day wider than the tolerance; right rows are
    repeated in the bins they can reach, so this is an equi join on (key, bin) and the reduction to
    the closest row reuses its partitioning. (key, left date) must be unique on the left.
    """
    width = tolerance_days + 1
    epoch = F.lit("1970-01-01").cast("date")

    def day(c: str) -> Column:
        return F.datediff(F.col(c), epoch)

    def bin_of(days: Column) -> Column:
        return F.floor(days / F.lit(width)).cast("int")

    others = [c for c in right.columns if c != key]
    reach = right.filter(F.col(right_date).isNotNull()).select(
        F.col(key).alias("_k"),
        F.struct(*others).alias("_r"),
        F.explode(
            F.sequence(bin_of(day(right_date) - F.lit(tolerance_days)), bin_of(day(right_date) + F.lit(tolerance_days)))
        ).alias("_rb"),
    )
    rest = [c for c in left.columns if c not in (key, left_date)]
    binned = left.select(key, left_date, F.struct(*rest).alias("_l") if rest else F.lit(None).alias("_l"), bin_of(day(left_date)).alias("_lb"))
    gap = F.abs(F.datediff(F.col(f"_r.{right_date}"), F.col(left_date)))
    # by merge: the reduction below takes its partitioning, and neither side is small because its files are
    joined = binned.hint("merge").join(
        reach,
        (F.col(key) == F.col("_k")) & (F.col("_lb") == F.col("_rb")) & (gap <= F.lit(tolerance_days)),
        "left",
    )
    closest = F.min_by("_r", F.when(F.col("_r").isNotNull(), F.struct(gap, F.col(f"_r.{right_date}"))))
    found = joined.groupBy(key, left_date, "_lb").agg(F.any_value("_l").alias("_l"), closest.alias(match))
    return found.select(*[F.col(c) if c in (key, left_date) else F.col(f"_l.{c}").alias(c) for c in left.columns], match)


def assign_zone(df: DataFrame, clusters: DataFrame, lat: str = "latitude", lon: str = "longitude", out: str = "cluster") -> DataFrame:
    """Point-in-box lookup against a table of zones, the lowest ordinal winning; NULL outside all of them.

    Zones are cut into one-degree cells, which turns the box test into an equi join on the cell.
    """

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low)).cast("int"), F.floor(F.col(high)).cast("int")))

    cells = clusters.withColumn("_clat", span("lat0", "lat1")).withColumn("_clon", span("lon0", "lon1")).select(
        F.col("cluster").alias("_zone"), "cluster_idx", "lat0", "lat1", "lon0", "lon1", "_clat", "_clon"
    )
    points = df.withColumn("_plat", F.floor(F.col(lat)).cast("int")).withColumn("_plon", F.floor(F.col(lon)).cast("int"))
    boxes = cells.groupBy("_clat", "_clon").agg(
        F.sort_array(F.collect_list(F.struct("cluster_idx", "_zone", "lat0", "lat1", "lon0", "lon1"))).alias("_boxes")
    )
    joined = points.join(
        boxes, (F.col("_plat") == F.col("_clat")) & (F.col("_plon") == F.col("_clon")), "left"
    )
    inside = F.filter(
        "_boxes",
        lambda b: F.col(lat).between(b["lat0"], b["lat1"]) & F.col(lon).between(b["lon0"], b["lon1"]),
    )
    return joined.withColumn(out, F.get(inside, F.lit(0))["_zone"]).select(*df.columns, out)


def interval_join(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, days: int
) -> DataFrame:
    """Pairs of one key with the right time in the closed interval [left, left + days].

    Time is cut into buckets of the horizon, and a right row meets the bucket of its own time and the
    one before, so a busy key is spread over its buckets and only neighbours in time are compared.
    The right side's columns must not collide with the left side's, except the key.
    """
    micros = days * 86_400 * 1_000_000

    def bucket(c: str) -> Column:
        return F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(micros)).cast("long")

    near = right.withColumn("_b", F.explode(F.array(bucket(right_ts), bucket(right_ts) - F.lit(1))))
    rows = left.withColumn("_b", bucket(left_ts)).join(near, [key, "_b"])
    upper = F.col(left_ts) + F.make_dt_interval(F.lit(days))
    return rows.filter(F.col(right_ts).between(F.col(left_ts), upper)).drop("_b")
