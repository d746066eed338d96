"""Evaluation of the baseline rankings under blocked folds."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import risk as R
from cropspark.operators import metrics, peers
from cropspark.operators.ranking import cumulative_counts, quantile_cuts
from cropspark.plans import evaluation as EV
from cropspark.queries.flatten import plain
from cropspark.queries.oracle import CTES, rounded, stress, veg
from cropspark.session import cut_lineage

_N = "n0 + n1 + n2"

CTES["label_totals"] = "\nSELECT cluster, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (WHERE label = {k}) AS c{k}" for k in range(3)) + " FROM canopy_clim GROUP BY 1"
CTES["folds_spatial"] = """
SELECT a.cluster AS fold, """ + ", ".join(f"CAST(sum(b.c{k}) AS BIGINT) AS n{k}" for k in range(3)) + """
FROM label_totals a JOIN label_totals b ON b.cluster <> a.cluster WHERE a.n >= 30 GROUP BY 1
HAVING sum(b.c0) > 0 AND sum(b.c1) > 0 AND sum(b.c2) > 0"""
CTES["date_list"] = """
SELECT obs_date, row_number() OVER (ORDER BY obs_date) - 1 AS pos, count(*) OVER () AS nd FROM (SELECT DISTINCT obs_date FROM canopy_clim)"""
CTES["cut_dates"] = """
SELECT a.obs_date AS cut, b.obs_date AS test_date FROM date_list a JOIN date_list b ON b.pos IN (a.pos, a.pos + 1)
JOIN (SELECT unnest([0.55e0, 0.55e0 + 0.12e0, 0.55e0 + 0.12e0 * 2]) AS share) s ON a.pos = floor(a.nd * s.share) WHERE a.nd >= 7"""
CTES["folds_temporal"] = """
SELECT c.cut, count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 2) AS n2
FROM (SELECT DISTINCT cut FROM cut_dates) c JOIN canopy_clim s ON s.obs_date < c.cut
WHERE (SELECT count(*) FROM canopy_clim t JOIN cut_dates d ON d.test_date = t.obs_date WHERE d.cut = c.cut) >= 30
GROUP BY 1 HAVING n0 > 0 AND n1 > 0 AND n2 > 0"""
CTES["eval_rows"] = f"""
SELECT 'spatial' AS protocol, s.cluster AS fold, s.site_id, s.obs_date, s.label AS y, s.forward_z AS z, s.ndvi_z_peer, s.clim_z_prior, f.n0, f.n1, f.n2
FROM canopy_clim s JOIN folds_spatial f ON f.fold = s.cluster
UNION ALL
SELECT 'temporal', CAST(c.cut AS VARCHAR), s.site_id, s.obs_date, s.label, s.forward_z, s.ndvi_z_peer, s.clim_z_prior, f.n0, f.n1, f.n2
FROM canopy_clim s JOIN cut_dates c ON c.test_date = s.obs_date JOIN folds_temporal f ON f.cut = c.cut"""
CTES["arm_rows"] = f"""
SELECT protocol, fold, site_id, obs_date, y, z, 'majority' AS arm, CASE WHEN n0 >= greatest(n1, n2) THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS pred, CAST(NULL AS DOUBLE) AS risk FROM eval_rows
UNION ALL SELECT protocol, fold, site_id, obs_date, y, z, 'persistence', {stress('ndvi_z_peer')}, -ndvi_z_peer FROM eval_rows
UNION ALL SELECT protocol, fold, site_id, obs_date, y, z, 'climatology', {stress('clim_z_prior')}, -clim_z_prior FROM eval_rows"""
CTES["per_class"] = """
SELECT protocol, fold, arm, k, count(*) FILTER (WHERE y = k AND pred = k) AS hit, count(*) FILTER (WHERE pred = k) AS predicted,
       count(*) FILTER (WHERE y = k) AS truth, count(*) AS n
FROM arm_rows CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2, 3, 4"""
CTES["class_scores"] = """
SELECT protocol, fold, arm, max(n) AS n,
       round_even(avg(CASE WHEN predicted + truth > 0 THEN 2e0 * hit / (predicted + truth) ELSE 0e0 END) FILTER (WHERE predicted + truth > 0), 4) AS macro_f1,
       round_even(avg(hit / truth) FILTER (WHERE truth > 0), 4) AS balanced_accuracy
FROM per_class GROUP BY 1, 2, 3"""
CTES["placed"] = """
SELECT *, row_number() OVER (PARTITION BY protocol, fold, arm ORDER BY risk DESC NULLS LAST, site_id, obs_date) AS place FROM arm_rows WHERE risk IS NOT NULL"""
CTES["top_scores"] = "\nSELECT protocol, fold, arm, " + ", ".join(
    f"round_even(avg(CASE WHEN y >= 1 THEN 1e0 ELSE 0e0 END) FILTER (WHERE place <= {k}), 4) AS precision_at_{k}" for k in K.TOP_K
) + " FROM placed GROUP BY 1, 2, 3"
CTES["avg_ranks"] = """
SELECT protocol, fold, arm, rank() OVER a + (count(*) OVER ta - 1) / 2e0 AS r1, rank() OVER b + (count(*) OVER tb - 1) / 2e0 AS r2
FROM arm_rows WHERE risk IS NOT NULL AND z IS NOT NULL
WINDOW a AS (PARTITION BY protocol, fold, arm ORDER BY risk), ta AS (PARTITION BY protocol, fold, arm, risk),
       b AS (PARTITION BY protocol, fold, arm ORDER BY -z), tb AS (PARTITION BY protocol, fold, arm, z)"""
CTES["rhos"] = """
SELECT protocol, fold, arm, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(r1) > 0 AND stddev_pop(r2) > 0 THEN round_even(corr(r1, r2), 4) END AS spearman
FROM avg_ranks GROUP BY 1, 2, 3"""
CTES["arm_scores"] = """
SELECT c.protocol, c.fold, c.arm, c.n, c.macro_f1, c.balanced_accuracy, t.precision_at_10, t.precision_at_25, t.precision_at_50, r.spearman
FROM class_scores c LEFT JOIN top_scores t ON t.protocol = c.protocol AND t.fold = c.fold AND t.arm = c.arm
LEFT JOIN rhos r ON r.protocol = c.protocol AND r.fold = c.fold AND r.arm = c.arm"""


def _quantile(group: str, value: str, position: str, source: str) -> str:
    """Interpolated quantile per group by explicit positions; ``position`` may use columns of the source."""
    order = f"PARTITION BY {group} ORDER BY {value}"
    return f"""SELECT {group}, max(CASE WHEN pos = floor(h) THEN {value} END) AS lo, max(CASE WHEN pos = ceil(h) THEN {value} END) AS hi, max(h - floor(h)) AS part
      FROM (SELECT {group}, {value}, row_number() OVER ({order}) - 1 AS pos, least(greatest({position}, 0e0), 1e0) * (count(*) OVER (PARTITION BY {group}) - 1) AS h FROM {source}) GROUP BY {group}"""


CTES["persist_spatial"] = "\nSELECT *, -ndvi_z_peer AS risk FROM eval_rows WHERE protocol = 'spatial'"
CTES["cut_one"] = "\n" + _quantile("fold", "risk", f"1e0 - n1 / ({_N}) - n2 / ({_N})", "persist_spatial")
CTES["cut_two"] = "\n" + _quantile("fold", "risk", f"1e0 - n2 / ({_N})", "persist_spatial")

_SWEEP = []
for _i, _m in enumerate(K.SWEEP_MULTIPLIERS):
    _p1, _p2 = f"least(p1 * {_m}e0, 0.98e0)", f"least(p2 * {_m}e0, 0.98e0)"
    CTES[f"sweep_pos_{_i}"] = f"""
SELECT 1 AS one, risk, y, 1e0 - {_p1} - {_p2} AS q1, 1e0 - {_p2} AS q2 FROM persist_spatial CROSS JOIN
 (SELECT sum(n1) / sum({_N}) AS p1, sum(n2) / sum({_N}) AS p2 FROM folds_spatial)"""
    _q1, _q2 = _quantile("one", "risk", "q1", f"sweep_pos_{_i}"), _quantile("one", "risk", "q2", f"sweep_pos_{_i}")
    CTES[f"sweep_pred_{_i}"] = f"""
SELECT s.y, CASE WHEN s.risk >= b.lo + (b.hi - b.lo) * b.part THEN 2 WHEN s.risk >= a.lo + (a.hi - a.lo) * a.part THEN 1 ELSE 0 END AS pred
FROM sweep_pos_{_i} s CROSS JOIN ({_q1}) a CROSS JOIN ({_q2}) b WHERE s.q1 > 0 AND s.q1 < s.q2"""
    _SWEEP.append(f"""SELECT {_m}e0 AS alert_rate_multiplier, round_even(avg(CASE WHEN pred >= 1 THEN 1e0 ELSE 0e0 END), 4) AS flagged_share,
      (SELECT round_even(avg(2e0 * hit / (predicted + truth)) FILTER (WHERE predicted + truth > 0), 4) FROM (
         SELECT k, count(*) FILTER (WHERE y = k AND pred = k) AS hit, count(*) FILTER (WHERE pred = k) AS predicted, count(*) FILTER (WHERE y = k) AS truth
         FROM sweep_pred_{_i} CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY k)) AS macro_f1,
      round_even(avg(CASE WHEN pred = 2 THEN 1e0 ELSE 0e0 END) FILTER (WHERE y = 2), 4) AS recall_severe,
      round_even(avg(CASE WHEN pred >= 1 THEN 1e0 ELSE 0e0 END) FILTER (WHERE y >= 1), 4) AS recall_elevated_or_worse
      FROM sweep_pred_{_i} HAVING count(*) > 0""")
_SWEEP_SQL = " UNION ALL ".join(_SWEEP)


def _samples(d):
    """Peer-standardised samples with their climatology, read back from the shared folder by each step."""
    return cut_lineage(EV.site_climatology(d.canopy_z))


def _rows(d, *protocols):
    samples = _samples(d)
    out = None
    for p in protocols:
        part = EV.test_rows(samples, d.n_clusters, p)
        out = part if out is None else out.unionByName(part)
    return out


def _both(d):
    return cut_lineage(EV.baseline_arms(_rows(d, "spatial", "temporal")))


def _persistence_rows(d):
    return _rows(d, "spatial").withColumn("risk", -F.col("ndvi_z_peer"))


def _decided(d):
    return EV.decide(_persistence_rows(d), ["protocol", "fold"], d.n_clusters)


def _calibration(d):
    p = R.hazard_probabilities(R.vegetation_hazard(F.col("ndvi_z_peer")))
    rows = _rows(d, "spatial").select("fold", "y", *[p[k].alias(k) for k in ("low", "medium", "high")])
    return metrics.calibration_error(rows, ["fold"], ["low", "medium", "high"])


_VEG = veg("ndvi_z_peer")
_ECE_SQL = f"""SELECT fold, round_even(sum(CASE WHEN bin > 0 THEN n * abs(acc - cnf) ELSE 0e0 END) / sum(n), 4) AS ece FROM (
  SELECT fold, bin, count(*) AS n, avg(hit) AS acc, avg(conf) AS cnf FROM (
    SELECT fold, conf, CAST(CASE WHEN lo = conf THEN 0 WHEN mid = conf THEN 1 ELSE 2 END = y AS INTEGER) AS hit,
      {' + '.join(f"CASE WHEN conf > {i * 0.1!r}e0 THEN 1 ELSE 0 END" for i in range(10))} AS bin
    FROM (SELECT *, greatest(lo, mid, hi) AS conf FROM (
      SELECT fold, y, round_even(CASE WHEN h <= 0.5e0 THEN 1e0 - 2e0 * h ELSE 0e0 END, 3) AS lo,
             round_even(CASE WHEN h <= 0.5e0 THEN 2e0 * h ELSE 2e0 - 2e0 * h END, 3) AS mid,
             round_even(CASE WHEN h <= 0.5e0 THEN 0e0 ELSE 2e0 * h - 1e0 END, 3) AS hi
      FROM (SELECT fold, y, {_VEG} AS h FROM eval_rows WHERE protocol = 'spatial')))) GROUP BY 1, 2) GROUP BY 1"""

_SCORES = ["macro_f1", "balanced_accuracy", "precision_at_10", "precision_at_25", "precision_at_50", "spearman"]


def _cluster_quantiles(d):
    samples = d.canopy_z.select("cluster", "ndvi")
    samples = cut_lineage(samples)
    counts = cumulative_counts(samples, ["cluster"], "ndvi", d.n_clusters)
    points = {f"q{int(q * 100)}": F.lit(q) for q in (0.05, 0.25, 0.5, 0.9)}
    return quantile_cuts(counts, ["cluster"], "ndvi", points, d.n_clusters)


def _fold_names(d):
    samples = _samples(d)
    names = lambda folds: sorted(r[0] for r in folds.select("fold").distinct().collect())
    return names(EV.spatial_folds(samples)), names(EV.temporal_folds(samples))


def _fold_references(d, samples, keys, columns):
    """References of all folds of both protocols from their training rows."""
    spatial, temporal = _fold_names(d)
    cuts = [dt.date.fromisoformat(c) for c in temporal]
    parts = [peers.spatial_references(samples, spatial, keys, columns).withColumn("protocol", F.lit("spatial"))]
    if cuts:
        parts.append(peers.temporal_references(samples, cuts, keys, columns).withColumn("protocol", F.lit("temporal")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _fold_reference_sql(table, columns, month):
    """The same references, each fold computed anew from its own training rows."""
    stats = ", ".join(f"avg(s.{c}) AS {c}_mu, stddev_samp(s.{c}) AS {c}_sigma" for c in columns)
    m, on, key = (", CAST(month(obs_date) AS INTEGER) AS month", " AND month(s.obs_date) = k.month", ", k.month") if month else ("", "", "")
    return f"""SELECT 'spatial' AS protocol, f.fold, k.cluster{key}, {stats} FROM folds_spatial f
               CROSS JOIN (SELECT DISTINCT cluster{m} FROM {table}) k
               LEFT JOIN {table} s ON (CASE WHEN k.cluster = f.fold THEN s.cluster <> f.fold ELSE s.cluster = k.cluster END){on} GROUP BY ALL
               UNION ALL SELECT 'temporal', CAST(f.cut AS VARCHAR), s.cluster{m.replace('obs_date', 's.obs_date')}, {stats}
               FROM folds_temporal f JOIN {table} s ON s.obs_date < f.cut GROUP BY ALL"""


def _stat_columns(columns):
    return [f"{c}_{m}" for c in columns for m in ("mu", "sigma")]


QUERIES = {
    "agg04_peer_reference_within_fold": (
        lambda d: plain(_fold_references(d, d.canopy, [F.month("obs_date").alias("month")], K.PEER_RELATIVE), 9),
        rounded(_fold_reference_sql("canopy", K.PEER_RELATIVE, True), *_stat_columns(K.PEER_RELATIVE), digits=9),
    ),
    "agg05_cluster_reference_within_fold": (
        lambda d: plain(_fold_references(d, d.stored_samples, [], K.CLUSTER_RELATIVE)),
        rounded(_fold_reference_sql("samples", K.CLUSTER_RELATIVE, False), *_stat_columns(K.CLUSTER_RELATIVE)),
    ),
    "ml04_agg14_flt12_spatial_folds": (
        lambda d: plain(EV.spatial_folds(_samples(d)).drop("cluster", "protocol")),
        rounded("SELECT fold, n0, n1, n2 FROM folds_spatial"),
    ),
    "ml05_set03_temporal_folds": (
        lambda d: plain(EV.temporal_folds(_samples(d)).drop("protocol")),
        rounded("""SELECT CAST(f.cut AS VARCHAR) AS fold, CAST(c.test_date AS VARCHAR) AS obs_date, f.n0, f.n1, f.n2
                   FROM folds_temporal f JOIN cut_dates c ON c.cut = f.cut"""),
    ),
    "agg14_majority_class": (
        lambda d: plain(_rows(d, "spatial", "temporal").select("protocol", "fold", EV.majority_class().alias("majority")).distinct()),
        rounded("SELECT DISTINCT protocol, fold, pred AS majority FROM arm_rows WHERE arm = 'majority'"),
    ),
    "agg15_exact_quantiles": (
        lambda d: plain(_cluster_quantiles(d)),
        rounded("""SELECT cluster, quantile_cont(ndvi, 0.05) AS q5, quantile_cont(ndvi, 0.25) AS q25, quantile_cont(ndvi, 0.5) AS q50,
                   quantile_cont(ndvi, 0.9) AS q90 FROM canopy_z GROUP BY 1""", "q5", "q25", "q50", "q90"),
    ),
    "agg16_calibration_error": (lambda d: plain(_calibration(d)), rounded(_ECE_SQL, "ece")),
    "agg17_fn25_baseline_classes": (
        lambda d: plain(metrics.classification_scores(_both(d), ["protocol", "fold", "arm"])),
        rounded("SELECT * FROM class_scores", "macro_f1", "balanced_accuracy"),
    ),
    "agg18_win11_precision_at_k": (
        lambda d: plain(metrics.precision_at_k(_both(d).filter(F.col("risk").isNotNull()), ["protocol", "fold", "arm"], "row_key")),
        rounded("SELECT * FROM top_scores", "precision_at_10", "precision_at_25", "precision_at_50"),
    ),
    "agg19_rank_correlation": (
        lambda d: plain(_rho(d)),
        rounded("SELECT * FROM rhos", "spearman"),
    ),
    "ml06_set01_baseline_evaluation": (
        lambda d: plain(EV.score_arms(_both(d), d.n_clusters)),
        rounded("SELECT * FROM arm_scores", *_SCORES),
    ),
    "agg25_fold_means": (
        lambda d: plain(EV.fold_means(EV.score_arms(_both(d), d.n_clusters))),
        rounded("SELECT protocol, arm, count(*) AS folds, " + ", ".join(f"round_even(avg({c}), 4) AS {c}" for c in _SCORES)
                + " FROM arm_scores GROUP BY 1, 2", *_SCORES),
    ),
    "fn24_agg26_decision_report": (
        lambda d: plain(metrics.classification_report(_decided(d), ["fold"])),
        rounded("""SELECT fold, k AS class, round_even(CASE WHEN predicted > 0 THEN hit / predicted ELSE 0e0 END, 3) AS precision,
                   round_even(CASE WHEN truth > 0 THEN hit / truth ELSE 0e0 END, 3) AS recall,
                   round_even(CASE WHEN predicted + truth > 0 THEN 2e0 * hit / (predicted + truth) ELSE 0e0 END, 3) AS f1, truth AS support FROM (
                   SELECT fold, k, count(*) FILTER (WHERE y = k AND pred = k) AS hit, count(*) FILTER (WHERE pred = k) AS predicted, count(*) FILTER (WHERE y = k) AS truth
                   FROM (SELECT r.fold, r.y, CASE WHEN r.risk >= b.lo + (b.hi - b.lo) * b.part THEN 2 WHEN r.risk >= a.lo + (a.hi - a.lo) * a.part THEN 1 ELSE 0 END AS pred
                         FROM persist_spatial r JOIN cut_one a ON a.fold = r.fold JOIN cut_two b ON b.fold = r.fold)
                   CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1, 2)""", "precision", "recall", "f1"),
    ),
    "agg20_alert_rate_sweep": (
        lambda d: plain(EV.sweep(cut_lineage(_persistence_rows(d)))),
        rounded(_SWEEP_SQL, "flagged_share", "macro_f1", "recall_severe", "recall_elevated_or_worse"),
    ),
    "agg23_sample_profile": (
        lambda d: plain(EV.profile(d.canopy_z)),
        rounded("""SELECT count(*) AS rows, count(DISTINCT site_id) AS sites, count(DISTINCT cluster) AS clusters, CAST(min(obs_date) AS VARCHAR) AS first_date,
                   CAST(max(obs_date) AS VARCHAR) AS last_date, round_even(avg(CAST(label = 0 AS INTEGER)), 3) AS share_0,
                   round_even(avg(CAST(label = 1 AS INTEGER)), 3) AS share_1, round_even(avg(CAST(label = 2 AS INTEGER)), 3) AS share_2 FROM canopy_z""",
                "share_0", "share_1", "share_2"),
    ),
}


def _rho(d):
    from cropspark.operators.ranking import rank_correlation

    arms = _both(d).filter(F.col("risk").isNotNull()).withColumn("w", -F.col("z"))
    return rank_correlation(arms, ["protocol", "fold", "arm"], "risk", "w", EV.max_groups(d.n_clusters) * 3)
