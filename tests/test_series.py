"""Series with running totals, range ranks and fold references against plain loops."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.functions import registry
from cropspark.operators import calendar, peers, ranking, weather
from cropspark.plans import evaluation as EV
from cropspark.session import cut_lineage

DAY0 = dt.date(2024, 1, 1)
SCHEMA = "site_id long, date date, tmax double, tmin double, rain double, et0 double, rh double, radiation double"


def onset_by_hand(rain):
    for i in range(len(rain) - 3):
        if sum(rain[i : i + 3]) < 20:
            continue
        run = 0
        for r in rain[i + 3 : i + 33]:
            run = run + 1 if r < 1 else 0
            if run == 10:
                break
        if run < 10:
            return i
    return None


def longest_dry(rain):
    best = run = 0
    for r in rain:
        run = run + 1 if r < 1 else 0
        best = max(best, run)
    return best


def test_windows_of_series_with_gaps_and_late_seasons(spark):
    draw = random.Random(9)
    rows, dense = [], {}
    for site in range(30):
        rain, hot = [], []
        while len(rain) < 170:
            dry = draw.random() < 0.6
            rain += [0.0] * draw.randrange(1, 16) if dry else [draw.choice([2.0, 8.0, 15.0]) for _ in range(draw.randrange(1, 5))]
        rain = rain[:170]
        hot = [draw.choice([30.0, 35.0, 36.5]) for _ in rain]
        kept, last = [], None
        for i in range(170):
            if i in (0, 169) or draw.random() > 0.15:
                last = i
                rows.append((site, DAY0 + dt.timedelta(i), hot[i], 18.0, rain[i], 4.0, 60.0, 20.0))
            kept.append((rain[last], hot[last]))
        dense[site] = kept
    ends = [90, 101, 117, 140, 169]
    asofs = spark.createDataFrame([(s, DAY0 + dt.timedelta(e)) for s in dense for e in ends], "site_id long, obs_date date")
    data = spark.createDataFrame(rows, SCHEMA)
    got = weather.window_totals(weather.cut_windows(calendar.site_series(data), asofs, "obs_date")).collect()
    assert len(got) == len(dense) * len(ends)
    late = 0
    for r in got:
        end = (r.obs_date - DAY0).days
        window = dense[r.site_id][end - 90 : end]
        rain = [w[0] for w in window]
        onset = onset_by_hand(rain)
        late += onset is not None and onset > 57
        assert r.days_since_onset == (0 if onset is None else 90 - onset)
        heat = [max(0.0, (min(t, 30.0) + 18.0) / 2 - 10) for _, t in window]
        assert r.heat_since_onset == pytest.approx(0.0 if onset is None else sum(heat[onset:]))
        assert r.heat_sum_90 == pytest.approx(sum(heat))
        assert r.rain_sum_90 == pytest.approx(sum(rain)) and r.rain_sum_30 == pytest.approx(sum(rain[60:]))
        assert r.hot_days_30 == sum(t >= 35 for _, t in window[60:]) and r.tmax_sum_30 == pytest.approx(sum(t for _, t in window[60:]))
        assert (r.dry_run_30, r.dry_run_90) == (longest_dry(rain[60:]), longest_dry(rain))
    assert late > 3  # seasons that only the end of the window decides


def test_short_series_have_no_windows(spark):
    data = spark.createDataFrame([(1, DAY0, 30.0, 18.0, 1.0, 4.0, 60.0, 20.0)], SCHEMA)
    series = calendar.site_series(data)
    r = series.first()
    assert r.n_days == 1 and r.rain_to == [0.0, 1.0] and bytes(r.season_marks) == b""
    asofs = spark.createDataFrame([(1, DAY0)], "site_id long, obs_date date")
    assert weather.cut_windows(series, asofs, "obs_date").count() == 0


def test_rank_plan_carries_no_array(spark):
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(50)] + [("b", float(i)) for i in range(50)], "g string, v double")
    counts = ranking.cumulative_counts(rows, ["g"], "v", 2, ranges=5)
    assert "array" not in counts._jdf.queryExecution().optimizedPlan().schema().simpleString()
    got = {(r.g, r.v): (r.n, r.before, r.total) for r in counts.collect()}
    values = {"a": [float(i % 7) for i in range(50)], "b": [float(i) for i in range(50)]}
    assert got == {(g, v): (own.count(v), sum(x < v for x in own), 50) for g, own in values.items() for v in own}


def fold_rows(spark):
    draw = random.Random(3)
    rows = []
    for i in range(400):
        day = DAY0 + dt.timedelta(days=draw.randrange(300))
        x = None if i % 11 == 0 else 5.0 + draw.gauss(0, 1e-3 if i % 4 == 0 else 1)
        rows.append(("abcd"[i % 4], day, x, float(i % 4)))
    return rows, spark.createDataFrame(rows, "cluster string, obs_date date, x double, y double")


def stats_of(values):
    values = [v for v in values if v is not None]
    return (statistics.fmean(values) if values else None, statistics.stdev(values) if len(values) > 1 else None)


def close(a, b):
    return a == b or (a is not None and b is not None and a == pytest.approx(b, abs=1e-9))


def test_references_within_spatial_folds(spark):
    rows, frame = fold_rows(spark)
    month = F.month("obs_date").alias("month")
    got = peers.spatial_references(frame, ["a", "c"], [month], ["x", "y"]).collect()
    assert {r.fold for r in got} == {"a", "c"} and len(got) == len({(r.fold, r.cluster, r.month) for r in got})
    for r in got:
        own = [v for v in rows if v[1].month == r.month and ((v[0] == r.cluster) if r.cluster != r.fold else (v[0] != r.fold))]
        for name, at in (("x", 2), ("y", 3)):
            mu, sigma = stats_of([v[at] for v in own])
            assert close(r[f"{name}_mu"], mu) and close(r[f"{name}_sigma"], sigma)


def test_references_before_each_cut(spark):
    rows, frame = fold_rows(spark)
    cuts = [DAY0 + dt.timedelta(days=n) for n in (100, 180, 250)]
    got = peers.temporal_references(frame, cuts, [], ["x"]).collect()
    assert len(got) == 12
    for r in got:
        mu, sigma = stats_of([v[2] for v in rows if v[0] == r.cluster and str(v[1]) < r.fold])
        assert close(r.x_mu, mu) and close(r.x_sigma, sigma)


def test_sql_functions_cover_the_rules(spark):
    names = registry.register(spark)
    assert len(names) == len(set(names)) and set(names) <= {r.function.split(".")[-1] for r in spark.sql("SHOW USER FUNCTIONS").collect()}
    row = spark.sql(
        """SELECT ndvi(0.5D, 0.1D) AS a, phenology_stage(900D, 'rice') AS b, assess_risk(0.8D, 1000D, 0.5D) AS c, month_keys(DATE '2024-03-15') AS d,
           coldstart_id(1.25D, 36.5D) AS e, recommended_action('NORMAL', assess_hazard(0.2D, 20, 0L, 0, 0D), false, 'Flowering', 'Maize') AS f,
           assess_vulnerability(true, NULL, NULL, NULL, 90D, NULL).gaps AS g, half_even_2(0.125D) AS h, well_formed_id('x') AS i"""
    ).first()
    assert row.a == pytest.approx(2 / 3) and row.b == "Flowering" and row.c.severity == "ELEVATED" and len(row.d) == K.N_MONTHS
    assert row.d[-1] == dt.date(2024, 3, 1) and row.d[0] == dt.date(2023, 4, 1) and row.e == "coldstart-1.2500-36.5000" and "Maize" in row.f
    assert "received_credit" in row.g and "has_extension_access" not in row.g and row.h == 0.12 and row.i is False


def test_drivers_without_gaps(spark):
    hazard = "named_struct('drought', 0.0D, 'disease', 0.0D, 'heat', 0.0D, 'vegetation', 0.0D, 'combined', 0.0D, 'dominant', 'none')"
    health = "named_struct('score', 80.0D, 'vigour', 0.5D, 'moisture', 0.5D, 'anomaly', 0.5D, 'status', 'Healthy')"
    registry.register(spark, ["risk_drivers"])
    call = f"risk_drivers({hazard}, 0.9D, 0D, 0, 0, 0D, 0L, {health}, %s)"
    row = spark.sql(f"SELECT {call % 'array()'} AS none, {call % 'CAST(NULL AS ARRAY<STRING>)'} AS missing, {call % chr(97)} AS three FROM VALUES (array('asset_score', 'market_access', 'received_credit')) t(a)").first()
    assert row.none == row.missing == [K.NO_DRIVERS] and row.three == [K.GAP_WORDING["asset_score"], K.GAP_WORDING["market_access"]]


def test_quantiles_of_many_small_groups(spark):
    draw = np.random.default_rng(4)
    rows = [(int(g), float(v)) for g in range(60) for v in draw.normal(size=int(draw.integers(1, 9)))]
    counts = ranking.cumulative_counts(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", 60, ranges=4)
    got = {r.g: r.m for r in ranking.quantile_cuts(counts, ["g"], "v", {"m": F.lit(0.3)}, 60).collect()}
    assert got == {g: pytest.approx(np.quantile([v for k, v in rows if k == g], 0.3)) for g in range(60)}

def test_rows_are_not_sent_to_the_few_cuts_of_their_groups(spark):
    made = spark.range(200_000).select(
        (F.col("id") % 3).cast("int").alias("g"), (F.col("id") % 3).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("risk"),
        *[F.lit(10 * (k + 1)).alias(c) for k, c in enumerate(EV.PRIOR)],
    )
    decided = EV.decide(cut_lineage(made), ["g"], 3)
    assert decided.count() == 200_000
    plan = decided._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
