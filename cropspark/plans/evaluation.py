"""Blocked evaluation of rankings: folds, baselines, decision rule, sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions.labels import stress_class
from cropspark.functions.numeric import half_even
from cropspark.operators import metrics
from cropspark.operators.lookup import join_bounded
from cropspark.operators.ranking import cumulative_counts, quantile_cuts, rank_correlation

PRIOR = [f"n{k}" for k in range(K.N_CLASSES)]
FOLD_KEYS = ["protocol", "fold"]


def site_climatology(samples: DataFrame) -> DataFrame:
    """Mean anomaly of a site's earlier observations, 0 without any."""
    earlier = Window.partitionBy("site_id").orderBy("obs_date").rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("clim_z_prior", F.coalesce(F.avg("ndvi_z_peer").over(earlier), F.lit(0.0)))


def _label_counts(samples: DataFrame, key: str) -> DataFrame:
    return samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_test"), *[F.count_if(F.col("label") == k).alias(c) for k, c in enumerate(PRIOR)]
    )


def _admissible() -> Column:
    trained = F.lit(True)
    for c in PRIOR:
        trained = trained & (F.col(c) > 0)
    return (F.col("n_test") >= K.MIN_TEST_ROWS) & trained


def spatial_folds(samples: DataFrame) -> DataFrame:
    """One row per held-out cluster with the label counts of all the others."""
    counts = _label_counts(samples, "cluster")
    whole = Window.partitionBy(F.lit(0))
    train = [(F.sum(c).over(whole) - F.col(c)).alias(c) for c in PRIOR]
    return (
        counts.select("cluster", "n_test", *train)
        .filter(_admissible())
        .select(F.lit("spatial").alias("protocol"), F.col("cluster").alias("fold"), "cluster", *PRIOR)
    )


def temporal_folds(samples: DataFrame, n_folds: int = K.TEMPORAL_FOLDS) -> DataFrame:
    """Forward chaining: train before a cut date, test on the next two observation dates.

    Works on one row per observation date, so the windows are as long as the calendar.
    """
    ordered = Window.partitionBy(F.lit(0)).orderBy("obs_date")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    dates = _label_counts(samples, "obs_date").select(
        "obs_date",
        "n_test",
        F.row_number().over(ordered).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n_dates"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in PRIOR],
        F.lead("obs_date").over(ordered).alias("next_date"),
        F.lead("n_test").over(ordered).alias("next_n"),
    ).filter(F.col("n_dates") >= n_folds + 4)
    shares = F.array(*[F.lit(K.TEMPORAL_START + K.TEMPORAL_STEP * i) for i in range(n_folds)])
    cuts = dates.select("*", F.posexplode(shares).alias("idx", "share")).filter(
        F.col("place") == F.floor(F.col("n_dates") * F.col("share")) + 1
    )
    folds = cuts.withColumn("n_test", F.col("n_test") + F.coalesce("next_n", F.lit(0))).filter(_admissible())
    return folds.select(
        F.lit("temporal").alias("protocol"),
        F.col("obs_date").cast("string").alias("fold"),
        F.explode(F.array_compact(F.array("obs_date", "next_date"))).alias("obs_date"),
        *PRIOR,
    )


def test_rows(samples: DataFrame, n_clusters: int, protocol: str) -> DataFrame:
    """The held-out rows of every fold of one protocol, each with its fold's training prior."""
    if protocol == "spatial":
        folds, key, bound = spatial_folds(samples), "cluster", n_clusters
    else:
        folds, key, bound = temporal_folds(samples), "obs_date", 2 * K.TEMPORAL_FOLDS
    joined = join_bounded(samples, folds, [key], bound)
    return joined.select(
        *FOLD_KEYS, F.struct("site_id", "obs_date").alias("row_key"), F.col("label").alias("y"),
        F.col("forward_z").alias("z"), *[c for c in samples.columns if c not in ("label", "forward_z")], *PRIOR,
    )


def majority_class() -> Column:
    """Most frequent training class, the lowest on ties."""
    top = F.greatest(*PRIOR)
    return F.when(F.col("n0") == top, 0).when(F.col("n1") == top, 1).otherwise(2)


def baseline_arms(rows: DataFrame) -> DataFrame:
    """Long table of the three baselines: (fold, arm, row, y, z, pred, risk)."""
    persistence, climatology = F.col("ndvi_z_peer"), F.col("clim_z_prior")
    arms = F.array(
        F.struct(F.lit("majority").alias("arm"), majority_class().alias("pred"), F.lit(None).cast("double").alias("risk")),
        F.struct(F.lit("persistence").alias("arm"), stress_class(persistence).alias("pred"), (-persistence).alias("risk")),
        F.struct(F.lit("climatology").alias("arm"), stress_class(climatology).alias("pred"), (-climatology).alias("risk")),
    )
    return rows.select(*FOLD_KEYS, "row_key", "y", "z", F.inline(arms))


def prior_positions() -> dict[str, Column]:
    """Quantile positions at which the risk is cut so the classes follow the training prior."""
    n = F.col("n0") + F.col("n1") + F.col("n2")
    return {"t1": F.lit(1.0) - F.col("n1") / n - F.col("n2") / n, "t2": F.lit(1.0) - F.col("n2") / n}


def decide(rows: DataFrame, groups: list[str], max_groups: int) -> DataFrame:
    """Class per row by cutting the group's risk at the quantiles of its training prior."""
    prior = rows.groupBy(*groups).agg(*[F.max(c).alias(c) for c in PRIOR])
    counts = cumulative_counts(rows, groups, "risk", max_groups)
    cuts = quantile_cuts(counts, groups, "risk", prior_positions(), max_groups, prior)
    joined = join_bounded(rows, cuts, groups, max_groups)
    pred = F.when(F.col("risk") >= F.col("t2"), 2).when(F.col("risk") >= F.col("t1"), 1).otherwise(0)
    return joined.withColumn("pred", pred)


def score_arms(arms: DataFrame, n_clusters: int) -> DataFrame:
    """All metrics of every (protocol, fold, arm) of a long table."""
    groups = [*FOLD_KEYS, "arm"]
    bound = max_groups(n_clusters) * 8
    ranked = arms.filter(F.col("risk").isNotNull())
    rho = rank_correlation(ranked.withColumn("_w", -F.col("z")), groups, "risk", "_w", bound).drop("n")
    top = metrics.precision_at_k(ranked, groups, "row_key")
    return metrics.classification_scores(arms, groups).join(top, groups, "left").join(rho, groups, "left")


def max_groups(n_clusters: int) -> int:
    return n_clusters + K.TEMPORAL_FOLDS


def fold_means(scores: DataFrame) -> DataFrame:
    """Mean of every metric over the folds of a protocol and arm."""
    names = ["macro_f1", "balanced_accuracy", *[f"precision_at_{k}" for k in K.TOP_K], "spearman"]
    return scores.groupBy("protocol", "arm").agg(
        F.count(F.lit(1)).alias("folds"), *[half_even(F.avg(c), 4).alias(c) for c in names]
    )


def sweep(rows: DataFrame) -> DataFrame:
    """Alert-rate sweep over pooled held-out rows: one row per admissible multiplier.

    Every multiplier's cuts come from one pass over the cumulative counts, and every multiplier's
    confusion counts from one pass over the rows.
    """
    folds = rows.select(*FOLD_KEYS, *PRIOR).groupBy(*FOLD_KEYS).agg(*[F.max(c).alias(c) for c in PRIOR])
    prior = folds.agg(*[F.sum(c).alias(c) for c in PRIOR]).withColumn("_one", F.lit(1))
    pooled = rows.select("y", "risk", F.lit(1).alias("_one"))
    n = F.col("n0") + F.col("n1") + F.col("n2")
    positions: dict[str, Column] = {}
    for i, m in enumerate(K.SWEEP_MULTIPLIERS):
        p1 = F.least(F.col("n1") / n * F.lit(m), F.lit(K.SWEEP_MAX_SHARE))
        p2 = F.least(F.col("n2") / n * F.lit(m), F.lit(K.SWEEP_MAX_SHARE))
        positions[f"q1_{i}"] = F.lit(1.0) - p1 - p2
        positions[f"q2_{i}"] = F.lit(1.0) - p2
    counts = cumulative_counts(pooled, ["_one"], "risk", 1)
    named = prior.select("_one", *[c.alias(f"p_{k}") for k, c in positions.items()])
    cuts = quantile_cuts(counts, ["_one"], "risk", {k: F.col(f"p_{k}") for k in positions}, 1, named)
    ready = join_bounded(join_bounded(pooled, cuts, ["_one"], 1), named, ["_one"], 1)
    cells = []
    for i in range(len(K.SWEEP_MULTIPLIERS)):
        pred = F.when(F.col("risk") >= F.col(f"q2_{i}"), 2).when(F.col("risk") >= F.col(f"q1_{i}"), 1).otherwise(0)
        for y in range(K.N_CLASSES):
            for p in range(K.N_CLASSES):
                cells.append(F.count_if((F.col("y") == y) & (pred == p)).alias(f"m{i}_{y}_{p}"))
        cells.append(F.max(f"p_q1_{i}").alias(f"m{i}_q1"))
        cells.append(F.max(f"p_q2_{i}").alias(f"m{i}_q2"))
    wide = ready.agg(F.count(F.lit(1)).alias("n"), *cells)
    per_rule = F.array(
        *[
            F.struct(
                F.lit(m).alias("alert_rate_multiplier"),
                *[F.col(f"m{i}_{y}_{p}").alias(f"c_{y}_{p}") for y in range(3) for p in range(3)],
                F.col(f"m{i}_q1").alias("q1"),
                F.col(f"m{i}_q2").alias("q2"),
            )
            for i, m in enumerate(K.SWEEP_MULTIPLIERS)
        ]
    )
    rules = wide.select("n", F.inline(per_rule)).filter((F.col("q1") > 0) & (F.col("q1") < F.col("q2")))
    alerts = F.col("n") - (F.col("c_0_0") + F.col("c_1_0") + F.col("c_2_0"))
    severe = F.col("c_2_0") + F.col("c_2_1") + F.col("c_2_2")
    worse = severe + F.col("c_1_0") + F.col("c_1_1") + F.col("c_1_2")
    caught = F.col("c_1_1") + F.col("c_1_2") + F.col("c_2_1") + F.col("c_2_2")
    return rules.select(
        "alert_rate_multiplier",
        half_even(alerts / F.col("n"), 4).alias("flagged_share"),
        half_even(metrics.macro_f1(), 4).alias("macro_f1"),
        half_even(F.when(severe > 0, F.col("c_2_2") / severe), 4).alias("recall_severe"),
        half_even(F.when(worse > 0, caught / worse), 4).alias("recall_elevated_or_worse"),
    )


def profile(samples: DataFrame) -> DataFrame:
    """Size, coverage, date range and class balance of a sample set."""
    n = F.count(F.lit(1))
    return samples.agg(
        n.alias("rows"),
        F.countDistinct("site_id").alias("sites"),
        F.countDistinct("cluster").alias("clusters"),
        F.min("obs_date").alias("first_date"),
        F.max("obs_date").alias("last_date"),
        *[half_even(F.count_if(F.col("label") == k) / n, 3).alias(f"share_{k}") for k in range(K.N_CLASSES)],
    )


def write_metrics(scores: DataFrame, path: str) -> None:
    """Metrics as JSON lines beside the model they belong to."""
    scores.write.mode("overwrite").json(path)
