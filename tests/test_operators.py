"""Operators against brute force on small inputs."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark.constants import CLUSTER_RELATIVE, ZONES
from cropspark.operators import calendar, canopy, lookup, metrics, peers, ranking, weather
from cropspark.plans import evaluation as EV

DAY0 = dt.date(2024, 1, 1)


def days(n, start=DAY0):
    return [start + dt.timedelta(days=i) for i in range(n)]


def weather_rows(spark, rain, site=1, start=DAY0, **over):
    rows = [
        (site, d, over.get("tmax", 30.0), over.get("tmin", 18.0), float(r) if r is not None else None, 4.0, 60.0, 20.0)
        for d, r in zip(days(len(rain), start), rain)
    ]
    return spark.createDataFrame(rows, "site_id long, date date, tmax double, tmin double, rain double, et0 double, rh double, radiation double")


def test_gap_filling(spark):
    rows = [(1, DAY0, None), (1, DAY0 + dt.timedelta(3), 5.0), (1, DAY0 + dt.timedelta(4), None), (1, DAY0 + dt.timedelta(6), 7.0), (2, DAY0, None)]
    df = spark.createDataFrame(rows, "site_id long, date date, rain double")
    got = calendar.dense_days(calendar.fill_gaps(df, ["rain"])).orderBy("site_id", "date").collect()
    assert [r.rain for r in got if r.site_id == 1] == [5.0, 5.0, 5.0, 5.0, 5.0, 5.0, 7.0]
    assert [r.rain for r in got if r.site_id == 2] == [None]


def test_incomplete_sites_are_refused(spark):
    good, bad = weather_rows(spark, [1.0] * 5), weather_rows(spark, [None] * 5, site=2)
    both = good.unionByName(bad)
    assert [r.site_id for r in calendar.complete_sites(both).collect()] == [1]
    assert [r.site_id for r in calendar.site_series(both).collect()] == [1]


def onset_by_hand(rain):
    n = len(rain)
    for i in range(n - 3):
        if rain[i] + rain[i + 1] + rain[i + 2] >= 20.0:
            run = best = 0
            for r in rain[i + 3 : i + 33]:
                run = run + 1 if r < 1.0 else 0
                best = max(best, run)
            if best < 10:
                return i
    return None


def dry_by_hand(rain):
    run = best = 0
    for r in rain:
        run = run + 1 if r < 1.0 else 0
        best = max(best, run)
    return best


def test_windows_match_plain_loops(spark):
    rnd = random.Random(5)
    frames, expected = [], {}
    for site in range(40):
        rain = [rnd.choice([0, 0, 0, 0.5, 2, 8, 15]) for _ in range(130)]
        frames.append((site, rain))
        for end in (90, 120):
            expected[site, end] = rain[end - 90 : end]
    data = None
    for site, rain in frames:
        part = weather_rows(spark, rain, site)
        data = part if data is None else data.unionByName(part)
    asofs = spark.createDataFrame([(s, DAY0 + dt.timedelta(e)) for s, e in expected] + [(0, DAY0 + dt.timedelta(89)), (0, DAY0 + dt.timedelta(130))], "site_id long, obs_date date")
    got = weather.window_totals(weather.cut_windows(calendar.site_series(data), asofs, "obs_date")).collect()
    assert len(got) == len(expected)
    for r in got:
        rain = expected[r.site_id, (r.obs_date - DAY0).days]
        onset = onset_by_hand(rain)
        assert r.days_since_onset == (0 if onset is None else 90 - onset)
        assert r.heat_since_onset == pytest.approx(0.0 if onset is None else 14.0 * (90 - onset))
        assert (r.dry_run_30, r.dry_run_90) == (dry_by_hand(rain[-30:]), dry_by_hand(rain))
        assert r.rain_sum_30 == pytest.approx(sum(rain[-30:])) and r.rain_sum_90 == pytest.approx(sum(rain))
        assert r.clim_rain_30 == pytest.approx(sum(rain[-30:]))


def test_scoring_window_ends_with_the_day(spark):
    data = weather_rows(spark, [0.0] * 89 + [7.0])
    asofs = spark.createDataFrame([(1, DAY0 + dt.timedelta(89))], "site_id long, asof date")
    series = calendar.site_series(data)
    r = weather.window_totals(weather.cut_windows(series, asofs, "asof", include_asof_day=True)).first()
    assert r.rain_sum_90 == 7.0
    assert weather.cut_windows(series, asofs, "asof").count() == 0


def test_rain_climatology(spark):
    n = 3 * 366
    rain = [(i * 7) % 11 for i in range(n)]
    data = weather_rows(spark, rain, start=dt.date(2023, 1, 1))
    when = dt.date(2025, 6, 1)
    asofs = spark.createDataFrame([(1, when)], "site_id long, obs_date date")
    all_days = days(n, dt.date(2023, 1, 1))
    hits = [i for i, d in enumerate(all_days) if (d.month, d.day) == (6, 1) and i >= 30]
    totals = {all_days[i].year: sum(rain[i - 30 : i]) for i in hits}
    series = calendar.site_series(data)
    other = weather.cut_windows(series, asofs, "obs_date").first().clim_rain
    every = weather.cut_windows(series, asofs, "obs_date", exclude_own_year=False).first().clim_rain
    assert other == pytest.approx(statistics.fmean(v for y, v in totals.items() if y != 2025))
    assert every == pytest.approx(statistics.fmean(totals.values()))
    leap = spark.createDataFrame([(1, dt.date(2024, 2, 29))], "site_id long, obs_date date")
    assert weather.cut_windows(series, leap, "obs_date").first().clim_rain is None


def test_nearest_date(spark):
    left = spark.createDataFrame([(1, dt.date(2025, 3, 18)), (1, dt.date(2025, 4, 30)), (1, dt.date(2025, 3, 10)), (2, DAY0)], "site_id long, sensing_date date")
    right = spark.createDataFrame(
        [(1, dt.date(2025, 3, 1), 0.2, 0.05, 0.8), (1, dt.date(2025, 3, 20), 0.0, 0.05, 4.0), (1, dt.date(2025, 5, 30), 0.2, 0.05, 0.8), (1, dt.date(2025, 3, 19), 0.4, 0.1, 0.8), (1, None, 9.0, 9.0, 9.0)],
        "site_id long, sensing_date date, vv double, vh double, rvi double")
    got = {r.sensing_date: r for r in canopy.with_radar(left, right).collect()}
    assert len(got) == 4
    assert got[dt.date(2025, 3, 18)].radar_date == dt.date(2025, 3, 19)
    assert got[dt.date(2025, 3, 10)].radar_date == dt.date(2025, 3, 1)
    assert got[dt.date(2025, 4, 30)].radar_date is None and got[DAY0].rvi is None


def test_nearest_date_brute_force(spark):
    rnd = random.Random(3)
    a = [(k, DAY0 + dt.timedelta(rnd.randrange(400))) for k in range(4) for _ in range(30)]
    a = sorted(set(a))
    b = sorted({(k, DAY0 + dt.timedelta(rnd.randrange(400))) for k in range(4) for _ in range(15)})
    left = spark.createDataFrame(a, "site_id long, d date")
    right = spark.createDataFrame(b, "site_id long, e date")
    got = {(r.site_id, r.d): r.matched.e if r.matched else None for r in lookup.nearest_date_join(left, right, "site_id", "d", "e", 20).collect()}
    for k, d in a:
        near = sorted((abs((e - d).days), e) for s, e in b if s == k and abs((e - d).days) <= 20)
        assert got[k, d] == (near[0][1] if near else None)


def test_zones(spark):
    points = spark.createDataFrame([(11.5, 8.2), (10.8, 7.9), (48.85, 2.35), (4.93, 6.34), (4.3, 5.6)], "latitude double, longitude double")
    zones = spark.createDataFrame([(n, i, *box) for i, (n, *box) in enumerate(ZONES)], "cluster string, cluster_idx int, lat0 double, lat1 double, lon0 double, lon1 double")
    want = ["Kaduna_Grain_Belt", "Kaduna_Grain_Belt", None, "Niger_Delta", "Niger_Delta"]
    got = {(r.latitude, r.longitude): r.cluster for r in lookup.assign_zone(points, zones).collect()}
    assert [got[p.latitude, p.longitude] for p in points.collect()] == want


def test_cohort_without_own_value(spark):
    rnd = random.Random(11)
    rows = [(s, c, DAY0, rnd.choice([0.1, 0.2, 0.3, 0.4, 0.55])) for c in ("a", "b") for s in range(12)] + [(s, "same", DAY0, 0.3) for s in range(9)]
    rows += [(99, "same", DAY0, 0.5), (98, "a", DAY0, None)]
    df = spark.createDataFrame(rows, "site_id long, cluster string, sensing_date date, ndvi double")
    got = {(r.cluster, r.ndvi): r for r in peers.value_cohorts(df, 3).collect()}
    for c in ("a", "b", "same"):
        values = [v for _, k, _, v in rows if k == c and v is not None]
        for v in set(values):
            rest = [x for x in values if x != v]
            r = got[c, v]
            assert r.n_peers == len(rest)
            if rest:
                assert r.peer_mean == pytest.approx(statistics.fmean(rest))
                assert r.peer_sd == pytest.approx(statistics.pstdev(rest), abs=1e-7)
    flat = df.filter("cluster = 'same'").select(peers.cohort_z(F.lit(0.5), F.lit(9), F.lit(0.3), F.lit(1e-9)).alias("z")).first()
    assert flat.z is None


def twin_frame(spark):
    rnd = random.Random(1)
    rows = []
    for c in ("north", "south"):
        for i in range(40):
            row = [c, i] + [rnd.gauss(10, 3) for _ in CLUSTER_RELATIVE]
            row[2 + CLUSTER_RELATIVE.index("rh_mean_30")] = 55.0
            if i == 7:
                row[2 + CLUSTER_RELATIVE.index("ndvi")] = None
            rows.append(tuple(row))
    return spark.createDataFrame(rows, "cluster string, i int, " + ", ".join(f"{c} double" for c in CLUSTER_RELATIVE))


def test_twins(spark):
    df = twin_frame(spark)
    got = peers.with_twins(df, peers.cluster_stats(df), 2)
    rows = got.collect()
    for c in CLUSTER_RELATIVE:
        values = [r[c + "_cz"] for r in rows if r.cluster == "north" and r[c + "_cz"] is not None]
        assert statistics.fmean(values) == pytest.approx(0.0, abs=1e-9)
    assert all(r.rh_mean_30_cz == 0.0 for r in rows)
    assert [r.ndvi_cz for r in rows if r.i == 7] == [None, None]
    alone = df.filter("cluster = 'north'")
    single = {r.i: r.gdd_90_cz for r in peers.with_twins(alone, peers.cluster_stats(alone), 1).collect()}
    assert all(single[r.i] == pytest.approx(r.gdd_90_cz, abs=1e-9) for r in rows if r.cluster == "north")
    stranger = df.limit(1).withColumn("cluster", F.lit("west"))
    assert peers.with_twins(stranger, peers.cluster_stats(df), 2).first().gdd_90_cz is None


def test_peer_lookup(spark):
    stats = spark.createDataFrame([("a", 3, 0.5, 0.1, 0.6, 0.2)], "cluster string, month int, ndvi_mu double, ndvi_sigma double, rvi_mu double, rvi_sigma double")
    rows = spark.createDataFrame([("a", dt.date(2025, 3, 5), 0.32, 0.4), ("a", dt.date(2025, 4, 5), 0.32, 0.4), (None, dt.date(2025, 3, 5), 0.3, None)], "cluster string, obs_date date, ndvi double, rvi double")
    got = peers.with_peer_z(rows, stats, 1).collect()
    assert got[0].ndvi_z_peer == pytest.approx(-1.8) and got[0].rvi_z_peer == pytest.approx(-1.0)
    assert got[1].ndvi_z_peer is None and got[2].ndvi_z_peer is None


def test_order_statistics_with_a_hot_value(spark):
    rnd = random.Random(2)
    values = [0.0] * 400 + [round(rnd.gauss(0, 2), 2) for _ in range(800)]
    groups = ["x" if rnd.random() < 0.7 else "y" for _ in values]
    other = [rnd.gauss(0, 1) + v for v in values]
    df = spark.createDataFrame(list(zip(groups, values, other)), "g string, v double, w double")
    counts = ranking.cumulative_counts(df, ["g"], "v", 2)
    points = {"a": F.lit(0.1), "b": F.lit(0.5), "c": F.lit(0.987)}
    got = {r.g: r for r in ranking.quantile_cuts(counts, ["g"], "v", points, 2).collect()}
    rho = {r.g: r.spearman for r in ranking.rank_correlation(df, ["g"], "v", "w", 2).collect()}
    for g in ("x", "y"):
        mine = np.array([v for k, v in zip(groups, values) if k == g])
        pair = np.array([w for k, w in zip(groups, other) if k == g])
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.987)):
            assert got[g][name] == pytest.approx(np.quantile(mine, q))

        def ranks(x):
            return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

        assert rho[g] == pytest.approx(np.corrcoef(ranks(mine), ranks(pair))[0, 1], abs=1e-4)


def test_rank_correlation_degenerate(spark):
    z = [-2.0, -1.0, 0.0, 1.0, 2.0]
    rows = [("up", r, -v) for r, v in zip([5.0, 4.0, 3.0, 2.0, 1.0], z)] + [("down", r, -v) for r, v in zip([1.0, 2.0, 3.0, 4.0, 5.0], z)]
    rows += [("flat", 1.0, v) for v in z] + [("few", 1.0, 2.0), ("few", 2.0, 3.0), ("few", None, 4.0)]
    df = spark.createDataFrame(rows, "g string, risk double, w double")
    got = {r.g: r.spearman for r in ranking.rank_correlation(df, ["g"], "risk", "w", 4).collect()}
    assert got["up"] == 1.0 and got["down"] == -1.0 and got["flat"] is None and got["few"] is None


def test_precision_at_k(spark):
    rows = [("f", i, 1 if i < 6 else 0, float(10 - i)) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, id int, y int, risk double")
    strict = metrics.precision_at_k(df, ["g"], "id", [5, 10, 20, 0], shrink=False).first()
    assert strict.precision_at_5 == 1.0 and strict.precision_at_10 == 0.6
    assert strict.precision_at_20 is None and strict.precision_at_0 is None
    assert metrics.precision_at_k(df, ["g"], "id", [20]).first().precision_at_20 == 0.6


def test_classification_metrics(spark):
    y, p = [0, 0, 1, 1, 2, 2, 2], [0, 1, 1, 1, 2, 0, 2]
    df = spark.createDataFrame([("g", a, b) for a, b in zip(y, p)], "g string, y int, pred int")
    r = metrics.classification_scores(df, ["g"]).first()
    f1 = [2 * 1 / (2 + 2), 2 * 2 / (3 + 2), 2 * 2 / (2 + 3)]
    assert r.macro_f1 == pytest.approx(sum(f1) / 3, abs=1e-4)
    assert r.balanced_accuracy == pytest.approx((0.5 + 1.0 + 2 / 3) / 3, abs=1e-4)
    report = {x["class"]: x for x in metrics.classification_report(df, ["g"]).collect()}
    assert report[2].precision == 1.0 and report[2].support == 3


def test_calibration_error(spark):
    rows = [("g", 0, 0.9, 0.05, 0.05), ("g", 1, 0.9, 0.05, 0.05), ("g", 2, 0.1, 0.3, 0.6)]
    df = spark.createDataFrame(rows, "g string, y int, p0 double, p1 double, p2 double")
    want = (2 / 3) * abs(0.5 - 0.9) + (1 / 3) * abs(1.0 - 0.6)
    assert metrics.calibration_error(df, ["g"], ["p0", "p1", "p2"]).first().ece == pytest.approx(want, abs=1e-4)


def test_site_climatology(spark):
    rows = [(1, DAY0 + dt.timedelta(i), float(i)) for i in range(5)] + [(2, DAY0, None), (2, DAY0 + dt.timedelta(1), 3.0)]
    df = spark.createDataFrame(rows, "site_id long, obs_date date, ndvi_z_peer double")
    got = EV.site_climatology(df).orderBy("site_id", "obs_date").collect()
    assert [r.clim_z_prior for r in got] == [0.0, 0.0, 0.5, 1.0, 1.5, 0.0, 0.0]


def test_latest_by_prefers_dated_rows(spark):
    rows = [(1, 10, None), (1, 11, dt.datetime(2024, 1, 1)), (1, 12, dt.datetime(2024, 1, 1)), (2, 5, None), (2, 6, None)]
    df = spark.createDataFrame(rows, "k long, id long, created_at timestamp_ntz")
    got = {r.k: r.id for r in lookup.latest_by(df, ["k"], ["created_at", "id"], ["id"]).collect()}
    assert got == {1: 12, 2: 6}


def test_interval_join_with_a_busy_field(spark):
    rnd = random.Random(8)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randrange(24 * 120))
    p = [(i, 0 if i % 3 else rnd.randrange(5), at()) for i in range(120)]
    o = [(1000 + i, 0 if i % 3 else rnd.randrange(5), at()) for i in range(120)]
    o.append((2000, p[0][1], p[0][2] + dt.timedelta(days=30)))
    left = spark.createDataFrame(p, "id long, field_id long, predicted_at timestamp_ntz")
    right = spark.createDataFrame(o, "oid long, field_id long, observed_at timestamp_ntz")
    got = sorted((r.id, r.oid) for r in lookup.interval_join(left, right, "field_id", "predicted_at", "observed_at", 30).collect())
    want = sorted((i, j) for i, f, a in p for j, g, b in o if f == g and a <= b <= a + dt.timedelta(days=30))
    assert got == want and (0, 2000) in got


def test_a_hot_site_is_bounded_by_its_calendar(spark):
    """A site with most of the raw readings brings one row per day into its window."""
    from cropspark.sources.mapping import daily_weather

    n = 6000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 50).cast("long").alias("l_suppkey"),
        F.date_add(F.lit("1995-01-02").cast("date"), (F.col("id") % 97).cast("int")).cast("timestamp_ntz").alias("l_shipdate"),
        F.lit(20.0).alias("l_quantity"), F.lit(30000.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"))
    import tempfile

    folder = tempfile.mkdtemp(prefix="cropspark-test-")
    rows.write.parquet(f"{folder}/lineitem.parquet")
    daily = daily_weather(spark, folder)
    assert daily.filter("site_id = 1").count() == 97
    series = {r.site_id: r.n_days for r in calendar.site_series(daily).select("site_id", "n_days").collect()}
    assert series[1] == 97


def test_reference_join_leaves_the_strategy_to_the_planner(spark):
    big = spark.range(10).select(F.col("id").alias("k"))
    ref = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = lookup.join_reference(big, ref, ["k"])
    assert "hint" not in joined._jdf.queryExecution().logical().toString().lower()
    assert joined.count() == 10


def test_two_rows_of_one_day(spark):
    day = lambda n: dt.date(2024, 1, n)
    schema = "site_id long, date date, tmax double, tmin double, rain double, et0 double, rh double, radiation double"
    rows = [(1, day(1), 20.0, 10.0, 0.0, 3.0, 50.0, 15.0), (1, day(1), 21.0, 10.0, 0.0, 3.0, 50.0, None), (1, day(4), 22.0, 10.0, 0.0, 3.0, 50.0, 15.0)]
    filled = calendar.fill_gaps(spark.createDataFrame(rows, schema))
    assert [(r.date, r.tmax, r.radiation, r.days) for r in filled.orderBy("date").collect()] == [(day(1), 21.0, 15.0, 3), (day(4), 22.0, 15.0, 1)]
    dense = sorted(r.date for r in calendar.dense_days(filled).collect())
    assert dense == [day(n) for n in range(1, 5)]


def test_a_second_pull_replaces_its_days_only(spark):
    from cropspark.sources.landed import latest_pull

    rows = spark.createDataFrame([(1, "a", 1, 5.0), (1, "b", 1, 6.0), (1, "b", 2, 7.0), (1, "b", 2, 7.0), (2, "a", 1, 1.0)], "site_id long, date string, pulled_at int, rain double")
    got = sorted(tuple(r) for r in latest_pull(rows, ["site_id", "date"]).collect())
    assert got == [(1, "a", 5.0), (1, "b", 7.0), (2, "a", 1.0)]


def test_severity_counts_the_last_fifteen_days(spark):
    from cropspark.operators import weather

    start = dt.datetime(2024, 5, 1)
    rows = [("s", start + dt.timedelta(hours=h), 20.0, 95.0) for h in range(60 * 24)] + [("short", start + dt.timedelta(days=59, hours=h), 20.0, 95.0) for h in range(20)]
    hourly = spark.createDataFrame(rows, "site_id string, ts timestamp_ntz, temp double, rh double")
    days = weather.leaf_wetness(hourly)
    assert days.filter("site_id = 's'").count() == 60 and days.filter("site_id = 'short'").count() == 0
    from cropspark.functions.agronomy import daily_severity

    one = spark.range(1).select(daily_severity(F.lit(20.0), F.lit(24)).alias("v")).first().v
    totals = {r.site_id: r.dsv_total for r in weather.severity_totals(hourly, (start + dt.timedelta(days=59)).date()).collect()}
    assert totals == {"s": 15 * one}


def test_rank_ranges_are_cut_within_each_group(spark):
    rows = [("wide", float(i), float(i)) for i in range(200)] + [("narrow", 1e-6 * i, float(-i)) for i in range(200)]
    got = {r.g: r.spearman for r in ranking.rank_correlation(spark.createDataFrame(rows, "g string, a double, b double"), ["g"], "a", "b", 2).collect()}
    assert got == {"wide": 1.0, "narrow": -1.0}
