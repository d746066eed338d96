"""The append-only store on real files."""

import datetime as dt

from pyspark.sql import functions as F

from cropspark.constants import FEATURES
from cropspark.schemas import FIELD_FEATURES
from cropspark.sources import store

NOW = dt.datetime(2025, 6, 1, 12, 0)


def feature_rows(spark, keys):
    rows = []
    for field, at, ndvi in keys:
        features = tuple(ndvi if c == "ndvi" else (1 if c in ("heat_stress_days", "dry_spell_30", "dry_spell_90", "days_since_onset") else 0.5) for c in FEATURES)
        context = ("sentinel-2", at.date(), (50.0, 0.5, 0.5, 0.5, "Marginal"), 3, False)
        rows.append((field, at, 10.8, 7.9, "Maize", features, context))
    return spark.createDataFrame(rows, FIELD_FEATURES)


def test_ddl_is_repeatable(spark, tmp_path):
    store.ensure_schema(spark, str(tmp_path))
    store.ensure_schema(spark, str(tmp_path))
    names = set(spark.table("field_features").columns)
    assert names == {*FIELD_FEATURES.fieldNames(), "day"}
    for t in store.STORE_TABLES:
        spark.sql(f"DROP TABLE {t}")


def test_append_once_and_missing_values(spark, tmp_path):
    root = str(tmp_path)
    first = feature_rows(spark, [(1, NOW, float("nan")), (2, NOW, 0.4)])
    store.append(first.limit(0), root, "field_features")
    store.write_features(first, root)
    store.write_features(first.unionByName(feature_rows(spark, [(3, NOW, 0.3), (3, NOW, 0.3)])), root)
    rows = {r.field_id: r for r in store.read(spark, root, "field_features").collect()}
    assert sorted(rows) == [1, 2, 3] and store.read(spark, root, "field_features").count() == 3
    assert rows[1].features.ndvi is None and rows[2].features.ndvi == 0.4
    assert len(rows[2].features) == 29


def test_freshness_ends(spark):
    cases = {
        "hour": (NOW - dt.timedelta(hours=1), True), "now": (NOW, True), "edge": (NOW - dt.timedelta(hours=48), True),
        "old": (NOW - dt.timedelta(hours=48, seconds=1), False), "future": (NOW + dt.timedelta(hours=2), False), "none": (None, False),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, at timestamp_ntz")
    got = {r.k: r.f for r in df.select("k", store.is_fresh(F.col("at"), F.lit(NOW).cast("timestamp_ntz")).alias("f")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_only_the_latest_row_counts(spark):
    rows = feature_rows(spark, [(1, NOW - dt.timedelta(hours=3), 0.1), (1, NOW - dt.timedelta(hours=1), 0.2), (2, NOW - dt.timedelta(hours=1), 0.3), (2, NOW + dt.timedelta(hours=1), 0.4), (3, NOW - dt.timedelta(days=9), 0.5)])
    got = store.latest_features(rows, F.lit(NOW).cast("timestamp_ntz")).collect()
    assert [(r.field_id, r.features.ndvi) for r in got] == [(1, 0.2)]


def test_prune(spark, tmp_path):
    root = str(tmp_path)
    limit = NOW - dt.timedelta(days=90)
    at = [limit - dt.timedelta(days=3), limit - dt.timedelta(hours=1), limit, limit + dt.timedelta(hours=1), NOW]
    store.append(feature_rows(spark, [(i, t, 0.1) for i, t in enumerate(at)]), root, "field_features")
    assert store.prune_features(spark, root, NOW) == 2
    assert sorted(r.field_id for r in store.read(spark, root, "field_features").collect()) == [2, 3, 4]
    assert store.prune_features(spark, root, NOW) == 0


def outcome_frame(spark, rows):
    return spark.createDataFrame(rows, "prediction_id long, field_id long, observed_at timestamp_ntz, outcome_type string, yield_t_ha double")


def test_label_join_cases(spark):
    predictions = spark.createDataFrame([(1, 7, NOW), (2, 8, NOW)], "id long, field_id long, predicted_at timestamp_ntz")
    day = lambda n: NOW + dt.timedelta(days=n)
    outcomes = outcome_frame(spark, [
        (1, 999, day(200), "harvest", 1.0), (None, 7, day(10), "agent_visit", None), (None, 7, day(95), "agent_visit", None),
        (None, 7, day(-5), "agent_visit", None), (None, 8, day(30), "diagnosis", None), (None, 8, day(0), "diagnosis", None), (55, 8, day(1), "harvest", None)])
    got = sorted((r.id, (r.observed_at - NOW).days) for r in store.label_join(predictions, outcomes).collect())
    assert got == [(1, 10), (1, 200), (2, 0), (2, 30)]
    assert store.label_count(predictions, outcomes).first().labelled_pairs == 4


def test_outcome_validation(spark, tmp_path):
    rows = outcome_frame(spark, [(None, 1, NOW, "harvest", 2.0), (None, 1, NOW, "harvest", 31.0), (None, 1, NOW, "rumour", None), (None, 1, NOW, "diagnosis", None), (None, None, NOW, "harvest", 1.0)])
    good, refused = store.split_outcomes(rows)
    assert (good.count(), refused.count()) == (2, 3)


def test_failed_audit_write_does_not_raise(spark, tmp_path):
    (tmp_path / "predictions").write_text("not a folder")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in store.STORE_TABLES["predictions"].fields}
    made = empty | {"id": F.col("id"), "field_id": F.col("id"), "predicted_at": F.lit(NOW).cast("timestamp_ntz")}
    rows = spark.range(1).select(*[c.alias(n) for n, c in made.items()])
    assert store.write_predictions(rows, str(tmp_path)) is None
    assert store.write_predictions(spark.range(1).select("id"), str(tmp_path)) is None


def test_declared_tables_are_read_by_name(spark, tmp_path):
    root = str(tmp_path)
    store.ensure_schema(spark, root)
    try:
        limit = NOW - dt.timedelta(days=90)
        store.append(feature_rows(spark, [(1, limit - dt.timedelta(days=2), 0.1), (2, NOW, 0.2)]), root, "field_features")
        store.write_features(feature_rows(spark, [(2, NOW, 0.2), (3, NOW, 0.3)]), root)
        assert sorted(r.field_id for r in spark.table("field_features").collect()) == [1, 2, 3]
        assert store.prune_features(spark, root, NOW) == 1
        assert sorted(r.field_id for r in spark.table("field_features").collect()) == [2, 3]
        assert store.read(spark, root, "field_features").count() == 2
    finally:
        for t in store.STORE_TABLES:
            spark.sql(f"DROP TABLE {t}")


def test_json_safe_nested(spark):
    df = spark.sql("SELECT named_struct('a', double('NaN'), 'b', array(double('Infinity'), 1D), 'c', map('k', double('NaN'))) AS s")
    s = store.clean(df).first().s
    assert s.a is None and s.b == [None, 1.0] and s.c == {"k": None}


class Died(Exception):
    pass


def test_a_run_that_dies_before_its_commit_adds_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = feature_rows(spark, [(1, NOW, 0.1), (2, NOW - dt.timedelta(days=1), 0.2)])

    def dies(*_):
        raise Died

    monkeypatch.setattr(store, "_commit", dies)
    try:
        store.append(rows, root, "field_features", "night")
    except Died:
        pass
    monkeypatch.undo()
    assert store.read(spark, root, "field_features").count() == 0
    assert store.append(rows, root, "field_features", "night") == 2
    assert store.append(rows, root, "field_features", "night") == 0
    assert store.read(spark, root, "field_features").count() == 2


def test_a_run_that_dies_after_its_commit_is_finished_by_readers(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = feature_rows(spark, [(i, NOW - dt.timedelta(days=i), 0.1) for i in range(4)])
    moved = []
    move = store._Files.move

    def dies(self, source, target):
        if target.startswith("day="):
            moved.append(target)
            if len(moved) > 2:
                raise Died
        return move(self, source, target)

    monkeypatch.setattr(store._Files, "move", dies)
    try:
        store.append(rows, root, "field_features", "night")
    except Died:
        pass
    monkeypatch.undo()
    assert len(moved) == 3
    assert store.append(rows, root, "field_features", "night") == 0
    assert sorted(r.field_id for r in store.read(spark, root, "field_features").collect()) == [0, 1, 2, 3]
    assert list((tmp_path / "field_features" / store.STAGING).iterdir()) == []


def test_of_two_runs_of_a_batch_the_first_to_commit_counts(spark, tmp_path):
    root, base = str(tmp_path), f"{tmp_path}/field_features"
    files = store._Files(spark, base)
    rows = feature_rows(spark, [(1, NOW, 0.1)])
    for run in "ab":
        rows.withColumn("day", F.to_date("computed_at")).write.partitionBy("day").parquet(f"{base}/{store.STAGING}/night-{run}")
    assert store._commit(files, "night", f"{store.STAGING}/night-b", 1)
    assert not store._commit(files, "night", f"{store.STAGING}/night-a", 1)
    assert store.read(spark, root, "field_features").count() == 1


def test_pruning_counts_in_the_pass_that_rewrites(spark, tmp_path):
    root = str(tmp_path)
    limit = NOW - dt.timedelta(days=90)
    store.append(feature_rows(spark, [(i, limit - dt.timedelta(hours=i), 0.1) for i in range(1, 9)]), root, "field_features")
    assert store.prune_features(spark, root, NOW) == 8  # the day of the limit goes whole
    assert store.read(spark, root, "field_features").count() == 0
    assert store.prune_features(spark, root, NOW) == 0


def test_readers_of_buckets_do_not_shuffle_the_store(spark, tmp_path):
    rows = [(i % 40, NOW - dt.timedelta(hours=i), i) for i in range(400)]
    log = spark.createDataFrame(rows, "field_id long, computed_at timestamp_ntz, row_id long")
    try:
        a = store.by_field(log, "log_buckets", str(tmp_path / "a"), 5)
        b = store.by_field(log.filter("row_id < 100"), "few_buckets", str(tmp_path / "b"), 5)
        latest = store.latest_by(a, ["field_id"], ["computed_at"], ["row_id"])
        both = latest.join(b.groupBy("field_id").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "field_id")
        assert {r.field_id: (r.row_id, r.n) for r in both.collect()} == {f: (f, sum(x % 40 == f for x in range(100))) for f in range(40)}
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        again = store.by_field(log.filter("row_id < 7"), "log_buckets", str(tmp_path / "a"), 5)
        assert again.count() == 7
    finally:
        for name in ("log_buckets", "few_buckets"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_batch_has_about_as_many_files_as_days(spark, tmp_path):
    root = str(tmp_path)
    days = [NOW - dt.timedelta(days=d) for d in range(6)]
    rows = feature_rows(spark, [(f, at, 0.4) for f in range(16) for at in days]).repartition(8)
    assert store.append(rows, root, "field_features") == 96 and store.append(rows.limit(0), root, "field_features") == 0
    assert len(list(tmp_path.glob("field_features/day=*/*.parquet"))) == 6  # was 48: one for each day and task
    assert store.read(spark, root, "field_features").count() == 96


def test_stored_keys_do_not_go_through_the_driver(spark):
    stored, batch = feature_rows(spark, [(1, NOW, 0.1)]), feature_rows(spark, [(1, NOW, 0.2), (2, NOW, 0.3)])
    fresh = store.new_rows(stored, batch, ["field_id", "computed_at"], ["latitude", "longitude"])
    assert [r.field_id for r in fresh.collect()] == [2]
    assert "Broadcast" not in fresh._jdf.queryExecution().executedPlan().toString()
