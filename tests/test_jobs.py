"""Jobs on small inputs: encoder inputs, inference, snapshot contract, learned arms, streams."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark import constants as K
from cropspark.operators import calendar
from cropspark.plans import embeddings as EM
from cropspark.plans import evaluation as EV
from cropspark.plans import farmers
from cropspark.plans import models as MO
from cropspark.plans.features import run_summary
from cropspark.queries import domain
from cropspark.sources import snapshot
from cropspark.streaming import wetness as SW
from cropspark.streaming.runs import rocksdb_state, run_to_files


def months_of_weather(spark):
    rows = [(1, dt.date(2024, 4, 1) + dt.timedelta(i), 30.0, 18.0, 30.0, 4.0, 60.0, 20.0) for i in range(365)]
    return spark.createDataFrame(rows, "site_id long, date date, tmax double, tmin double, rain double, et0 double, rh double, radiation double")


def encoder_inputs(spark, bands=None):
    day = dt.date(2025, 3, 15)
    sites = spark.createDataFrame([(1, 10.0, 8.0, 500.0)], "site_id long, latitude double, longitude double, elevation double")
    optical = spark.createDataFrame([(1, day, 0.6)], "site_id long, sensing_date date, ndvi double")
    radar = spark.createDataFrame([(1, day, 0.1, 0.0), (1, dt.date(2025, 2, 2), 0.1, 0.01)], "site_id long, sensing_date date, vv double, vh double")
    wanted = spark.createDataFrame([(1, day)], "site_id long, obs_date date")
    return EM.build_inputs(wanted, sites, calendar.fill_gaps(months_of_weather(spark)), optical, radar, bands)


def test_encoder_units_and_masks(spark):
    r = encoder_inputs(spark).first()
    x, m = np.array(r.x).reshape(12, 17), np.array(r.mask).reshape(12, 17)
    at = K.CHANNELS.index
    assert x[11, at("vv")] == pytest.approx(0.6) and x[11, at("vh")] == pytest.approx(-1.0)
    assert x[0, at("precip")] == pytest.approx(1.0) and x[0, at("temp")] == pytest.approx(25.0 / 35.0)
    assert m[11, at("vv")] == 0.0 and m[9, at("vv")] == 1.0 and m[10, at("ndvi")] == 1.0 and x[11, at("ndvi")] == pytest.approx(0.6)
    assert m[:, 2:12].all() and x[3, at("elevation")] == pytest.approx(0.25) and m[3, at("slope")] == 0.0
    assert r.month == 2


def test_bands_unmask_their_month(spark):
    row = (1, dt.date(2025, 3, 2), *[0.1 * (i + 1) for i in range(10)])
    bands = spark.createDataFrame([row], "site_id long, sensing_date date, " + ", ".join(f"{b} double" for b in K.BAND_KEYS))
    r = encoder_inputs(spark, bands).first()
    m = np.array(r.mask).reshape(12, 17)
    assert not m[11, 2:12].any() and m[10, 2:12].all()


def test_inference_batches_share_month_and_mask(spark):
    def encoder(x, mask, latlon, month):
        assert len(x) <= 3 and all((mask[0] == one).all() for one in mask)
        return np.full((len(x), 4), float(month)) + latlon[:, :1]

    x = F.array_repeat(F.lit(0.5).cast("float"), 204)
    hot = F.when(F.col("id") % 3 == 0, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")
    inputs = spark.range(200).select(
        F.col("id").alias("site_id"), F.lit("2025-03-01").cast("date").alias("obs_date"), F.col("id").cast("double").alias("latitude"),
        F.lit(0.0).alias("longitude"), F.lit(2).alias("month"), x.alias("x"), F.array_repeat(hot, 204).alias("mask"))
    got = {r.site_id: r.vector for r in EM.embed(inputs, encoder, 4, batch=3).collect()}
    assert len(got) == 200 and got[7] == [9.0] * 4


def test_embedding_merge_keeps_rows_and_refuses_duplicates(spark):
    day = dt.date(2025, 3, 1)
    samples = spark.createDataFrame([(1, day), (2, day)], "site_id long, obs_date date")
    vectors = spark.createDataFrame([(1, day, [1.0, 2.0])], "site_id long, obs_date date, vector array<float>")
    assert EM.attach_embeddings(samples, vectors).count() == 2
    c = EM.coverage(samples, vectors).first()
    assert (c.samples, c.covered, c.coverage, c["mean"], c["finite"]) == (2, 1, 0.5, 1.5, True)
    with pytest.raises(Exception, match="unique"):
        EM.attach_embeddings(samples, vectors.unionByName(vectors)).collect()


def test_missing_bands_stop_the_job(spark):
    sites = spark.createDataFrame([(1, "a"), (2, "b")], "site_id long, cluster string")
    bands = spark.createDataFrame([(1,)], "site_id long")
    with pytest.raises(RuntimeError, match="'b': 1"):
        EM.require_bands(sites.select("site_id"), bands, sites)


def test_artifact_paths():
    assert snapshot.artifact_path("r", K.MODEL_FEATURES) == "r/production"
    assert snapshot.artifact_path("r", MO.variant_features(no_radar=True), experimental=True) == "r/experimental/ablation"
    assert snapshot.artifact_path("r", MO.variant_features(embedding_size=2)) == "r/experimental/extra_features"
    assert len(K.MODEL_FEATURES) == 40 and len(MO.variant_features(no_radar=True)) == 35


def test_contract(spark):
    peer = spark.createDataFrame([("a", 1)], "cluster string, month int")
    meta = spark.createDataFrame([("v", "label")], "version string, target string")
    with pytest.raises(ValueError, match="forward_z"):
        snapshot.check_contract(meta, peer)
    with pytest.raises(ValueError, match="peer_stats"):
        snapshot.check_contract(spark.createDataFrame([("v", K.TARGET)], "version string, target string"), peer.limit(0))


def learned_frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(900):
        z = float(rng.normal())
        cluster = "abc"[i % 3]
        day = dt.date(2024, 1, 1) + dt.timedelta(30 * (i % 12))
        row = {c: float(rng.normal()) for c in K.FEATURES}
        row["ndvi_z_peer"] = z
        row["rvi"] = None if i % 9 == 0 else row["rvi"]
        f = z + 0.3 * float(rng.normal())
        row.update(site_id=i, cluster=cluster, obs_date=day, forward_z=f, label=2 if f <= -1 else (1 if f <= -0.35 else 0))
        rows.append(row)
    schema = ", ".join(f"{c} double" for c in K.FEATURES) + ", site_id long, cluster string, obs_date date, forward_z double, label int"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)


def test_boosting_goes_on_while_it_improves(spark):
    names = ["gdd_90", "rain_30", "rain_90", "tmax_mean_30", "rh_mean_30", "radiation_90"]
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    frame = learned_frame(spark).withColumn("forward_z", total).cache()
    model = MO.fit_regressor(frame, names, max_iter=60)
    assert MO.n_trees(model) > 20
    assert model.transform(frame).stat.corr("forecast_z", "forward_z") > 0.8


def test_patience():
    falling = [1 / (i + 1) for i in range(30)]
    assert MO.rounds_kept(falling) is None
    assert MO.rounds_kept(falling + [0.5] * 10) == 40
    assert MO.rounds_kept([0.5] * 9 + [0.4] + [0.5] * 12) == 20
    assert MO.rounds_kept([]) is None


def test_learned_arms_end_to_end(spark, tmp_path):
    frame = MO.model_frame(learned_frame(spark), 3).cache()
    scores, oof = MO.evaluate_arms(frame, 3, max_iter=8, protocols=("spatial",), arms=("regressor", "linear"))
    got = {(r.fold, r.arm): r for r in scores.collect()}
    assert {a for _, a in got} == {"regressor", "linear", "majority", "persistence", "climatology"} and len(got) == 15
    assert all(got[f, "regressor"].spearman > 0.5 and got[f, "linear"].ece is not None for f in "abc")
    assert {r.alert_rate_multiplier for r in EV.sweep(oof).collect()} <= set(K.SWEEP_MULTIPLIERS)
    top = MO.importance_on_last_cluster(frame, 3, K.MODEL_FEATURES, max_iter=8, repeats=1).collect()
    assert top[0].feature == "ndvi_z_peer" and len(top) == 40
    clusters = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "cluster string, cluster_idx int")
    path = MO.publish(frame, clusters, str(tmp_path), max_iter=4)
    snap = snapshot.load(spark, path)
    again = MO.forecast(learned_frame(spark), snap)
    assert again.filter(F.col("forecast_z").isNull()).count() == 0 and snap.feature_columns == K.MODEL_FEATURES
    EV.write_metrics(scores, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 15


def test_classifier_probabilities(spark):
    frame = MO.model_frame(learned_frame(spark), 3)
    model = MO.fit_classifier(frame, K.MODEL_FEATURES, max_iter=2, folds=2)
    rows = model.transform(frame).select(F.col("label"), *MO._probability_columns()).collect()
    assert all(abs(r.p0 + r.p1 + r.p2 - 1.0) < 1e-9 for r in rows)
    mean = lambda k: np.mean([r.p2 for r in rows if r.label == k])
    assert mean(2) > mean(0)


def test_run_summary(spark):
    ok = spark.createDataFrame([("sentinel-2",), ("sentinel-2",), ("unavailable",)], "index_source string")
    failed = spark.createDataFrame([(1, "no weather site")], "field_id long, reason string")
    r = run_summary(ok, failed, 5).first()
    assert (r.fields, r.ok, r.degraded, r.failed, r.pruned, r.degraded_rate) == (4, 3, 1, 1, 5, 0.333)
    assert run_summary(ok.limit(0), failed).first().degraded_rate is None


def test_streamed_days_and_running_total(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = []
    for day in range(5):
        for hour in range(24):
            rows.append({"site_id": "s", "ts": f"2024-01-0{day + 1}T{hour:02d}:00:00Z", "temp": 20.0, "rh": 95.0 if hour < 16 else 50.0, "sprayed": day == 2 and hour == 3})
    (source / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = spark.readStream.schema("site_id string, ts timestamp, temp double, rh double, sprayed boolean").json(str(source))
    daily = run_to_files(SW.daily_wetness(stream), "t", str(tmp_path / "daily"))
    got = spark.read.parquet(daily).orderBy("day").collect()
    assert [(r.wet_hours, r.severity) for r in got] == [(16, 2)] * 4
    days = spark.readStream.schema(spark.read.parquet(daily).schema).parquet(daily)
    with rocksdb_state(spark):
        total = run_to_files(SW.severity_since_spray(days), "u", str(tmp_path / "total"))
    assert [r.total for r in SW.latest_revision(spark.read.parquet(total)).orderBy("day").collect()] == [2, 4, 2, 4]
    (source / "b.json").write_text(json.dumps({"site_id": "s", "ts": "2024-01-02T05:00:00Z", "temp": 20.0, "rh": 99.0, "sprayed": False}))
    run_to_files(SW.daily_wetness(stream), "t", str(tmp_path / "daily"))
    again = spark.read.parquet(daily).filter("day = '2024-01-02'").collect()
    assert [r.wet_hours for r in again] == [16]


def test_days_in_any_order_and_late_sprays_are_summed_again(spark, tmp_path):
    import random

    draw = random.Random(5)
    start = dt.date(2024, 5, 1)
    days = [("a", start + dt.timedelta(days=i), draw.randrange(5), i in (4, 11)) for i in range(20)]
    days += [("b", start + dt.timedelta(days=i), draw.randrange(5), False) for i in range(0, 20, 3)]
    schema = "site_id string, day date, severity int, sprayed boolean"
    draw.shuffle(days)
    late = [("a", start + dt.timedelta(days=15), 0, True), ("b", start + dt.timedelta(days=6), 4, False)]  # a spray told late, a day told twice
    source = tmp_path / "in"
    for n, part in enumerate([days[:9], days[9:18], days[18:], late]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"batch={n}"))
        stream = spark.readStream.schema(schema).parquet(str(source / "batch=*"))
        with rocksdb_state(spark):
            out = run_to_files(SW.severity_since_spray(stream), "u", str(tmp_path / "total"))
    told = {}
    for site, day, severity, sprayed in days + late:
        old = told.get((site, day), (0, False))
        told[site, day] = (max(old[0], severity), old[1] or sprayed)
    want, total = {}, {}
    for (site, day), (severity, sprayed) in sorted(told.items()):
        total[site] = (0 if sprayed else total.get(site, 0)) + severity
        want[site, day] = (severity, total[site], total[site] >= K.SPRAY_THRESHOLD)
    got = {(r.site_id, r.day): (r.severity, r.total, r.spray_due) for r in SW.latest_revision(spark.read.parquet(out)).collect()}
    assert got == want


def test_closed_days_leave_the_state(spark, tmp_path):
    schema = "site_id string, day date, severity int, sprayed boolean"
    start = dt.date(2024, 5, 1)
    source = tmp_path / "in"
    for n, offsets in enumerate([(0, 1), (2, 10), (11, 1)]):  # the last batch has a day that was closed with the second
        part = [("a", start + dt.timedelta(days=i), 2, False) for i in offsets]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"batch={n}"))
        stream = spark.readStream.schema(schema).parquet(str(source / "batch=*"))
        with rocksdb_state(spark):
            out = run_to_files(SW.severity_since_spray(stream, "2 days"), "u", str(tmp_path / "total"))
    rows = SW.latest_revision(spark.read.parquet(out)).orderBy("day").collect()
    assert [(r.day - start).days for r in rows] == [0, 1, 2, 10, 11] and [r.total for r in rows] == [2, 4, 6, 8, 10]
    held = spark.read.format("statestore").option("stateVarName", "open").load(str(tmp_path / "total" / "state"))
    assert sorted(r.user_map_key.day - (start - dt.date(1970, 1, 1)).days for r in held.collect()) == [10, 11]


def test_statistics_within_folds_leave_out_what_is_held_out(spark):
    frame = MO.cut_lineage(MO.model_frame(learned_frame(spark), 3))
    frames = dict(MO.fold_frames(frame, 3, "spatial", ["a", "b", "c"]))
    assert set(frames) == {"a", "b", "c"}
    ndvi = {(r.site_id, r.cluster, r.obs_date.month): r.ndvi for r in frame.select("site_id", "cluster", "obs_date", "ndvi").collect()}
    for r in frames["b"].filter("cluster IN ('a', 'b')").select("site_id", "cluster", "obs_date", "ndvi_z_peer").limit(60).collect():
        others = [v for (_, c, m), v in ndvi.items() if m == r.obs_date.month and ((c == "a") if r.cluster == "a" else (c != "b"))]
        own = ndvi[r.site_id, r.cluster, r.obs_date.month]
        if len(others) > 1:
            assert abs(r.ndvi_z_peer - (own - np.mean(others)) / np.std(others, ddof=1)) < 1e-6
        else:
            assert r.ndvi_z_peer in (None, 0.0)
    scores, _ = MO.evaluate_arms(frame, 3, max_iter=1, protocols=("spatial",), arms=("regressor",), within_fold=True)
    assert {(r.fold, r.arm) for r in scores.collect()} == {(f, a) for f in "abc" for a in ("regressor", "majority", "persistence", "climatology")}


def test_observations_of_the_sites_are_built_once(monkeypatch):
    built, taken = [], []
    for name in ("daily_weather", "optical_obs", "radar_obs"):
        monkeypatch.setattr(domain.M, name, lambda spark, folder, name=name: built.append(name) or name)
    for name in ("sites", "clusters", "hourly_weather"):
        monkeypatch.setattr(domain.M, name, lambda spark, folder, name=name: name)
    for name in ("canopy_samples", "build_samples", "site_state"):
        monkeypatch.setattr(domain, name, lambda *tables: taken.append(tables[:3]))
    for name in ("peer_stats", "severity_by_station"):
        monkeypatch.setattr(domain, name, lambda *tables: None)
    monkeypatch.setattr(domain, "cut_lineage", lambda rows: rows)
    d = domain.Domain(None, "")
    d.__dict__.update(n_clusters=5, last_hourly_day=None)
    _ = d.canopy, d.samples, d.site_state
    assert taken == [("daily_weather", "optical_obs", "radar_obs")] * 3 and sorted(built) == sorted(taken[0])


def test_only_the_latest_farms_are_located(spark, monkeypatch):
    farms = spark.createDataFrame(
        [(1, 7, "2.0 ha", "O", dt.date(2024, 1, 1)), (2, 7, "3.0 ha", "O", dt.date(2024, 5, 1)), (3, 7, "4.0 ha", "P", None),
         (4, 8, "unknown", "P", None), (5, 8, "1.0 ha", "O", None), (6, None, "1.0 ha", "O", None)],
        "id long, farmer_profile_id long, farm_size string, state string, created_at date",
    )
    lines = spark.createDataFrame([(1, 10), (2, 11), (2, 12), (3, 11), (3, 13), (5, 10), (None, 14)], "farm_id long, crop_id long")
    tables = {
        "farms": farms,
        "farm_crops": lines,
        "farm_sites": spark.createDataFrame([(1, 100), (2, 200), (3, 100), (5, None)], "farm_id long, site_id long"),
        "sites": spark.createDataFrame([(100, 1.0, 2.0), (200, 3.0, 4.0), (200, 3.0, 4.0)], "site_id long, latitude double, longitude double"),
        "crops": spark.createDataFrame([(10, "Maize"), (11, "Rice"), (12, None), (13, "Rice")], "id long, name string"),
        "farmer_profiles": spark.createDataFrame([(7,), (8,), (9,)], "user_id long"),
        "survey": spark.createDataFrame([(7, 1.5, "x")], "farmer_id long, yield_value double, head_gender string"),
    }
    for name, rows in tables.items():
        monkeypatch.setattr(domain.M, name, lambda spark, folder, rows=rows: rows)
    d = domain.Domain(spark, "")
    # farmer 7's latest farm comes once for each row of its site, and no farm of an earlier date comes at all
    assert sorted((r.farmer_profile_id or 0, r.id) for r in d.located_farms.collect()) == [(0, 6), (7, 2), (7, 2), (8, 5)]
    got = {r.user_id: r for r in d.farmers.collect()}
    whole = farmers.farmer_features(
        tables["farmer_profiles"], farmers.located_farms(farms, tables["farm_sites"], tables["sites"]), lines, tables["crops"], tables["survey"].drop("head_gender")
    )
    assert got == {r.user_id: r for r in whole.collect()}
    assert (got[7].farm_id, got[7].site_id, got[7].crop_diversity_score) == (2, 200, 4) and got[9].crop_diversity_score == 0
