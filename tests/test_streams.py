"""The registered streams on rows of their own."""

import datetime as dt
import os

from cropspark.queries import streams
from cropspark.queries.domain import Domain


def test_the_spray_stream_takes_its_days_by_size_and_not_by_file(spark, tmp_path, monkeypatch):
    start = dt.datetime(2024, 5, 1)
    rows = [(i, f"s{i % 7}", start + dt.timedelta(hours=i // 7), float(i % 160)) for i in range(7 * 24 * 6)]
    made = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, value double")
    made.coalesce(1).write.parquet(str(tmp_path / "made"))
    [part] = (tmp_path / "made").glob("*.parquet")
    os.link(part, tmp_path / "events.parquet")
    roots, run = {}, streams.run_to_files
    monkeypatch.setattr(streams, "run_to_files", lambda stream, name: roots.setdefault(name, run(stream, name)))
    found = streams._since_spray(Domain(spark, str(tmp_path))).collect()
    assert len(found) == 7 * 5 and all(r["total"] >= 0 for r in found)  # the last day is still open
    files = [f for f in os.listdir(roots["wetness"]) if f.endswith(".parquet")]
    batches = [f for f in os.listdir(roots["spray"].replace("/out", "/state/sources/0")) if f.isdigit()]
    assert len(files) > 2 and len(batches) == 1


def test_links_keep_their_rows_outside_the_heap(spark, tmp_path, monkeypatch):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    orders = [(k, k % 3, day(5 * k)) for k in range(20)]
    lines = [(k, n, day(5 * k + 9 * n), "A", float(n)) for k in range(20) for n in range(1, 5)]
    for name, rows, schema in (
        ("orders", [(*o, "1-URGENT", 5000.0) for o in orders], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string, o_totalprice double"),
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_returnflag string, l_quantity double"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "made" / name))
        [part] = (tmp_path / "made" / name).glob("*.parquet")
        os.link(part, tmp_path / f"{name}.parquet")
    roots, run = [], streams.run_to_files
    monkeypatch.setattr(streams, "run_to_files", lambda stream, name: roots.append(run(stream, name)) or roots[-1])
    before = spark.conf.get("spark.sql.streaming.join.stateFormatVersion")
    got = [(r.id, r.observed_at.replace(tzinfo=None)) for r in streams._links(Domain(spark, str(tmp_path))).collect()]
    by_id = [(k, at) for k, n, at, *_ in lines if n == 1]
    by_time = [(p, at) for k, n, at, *_ in lines if n > 1 for p, field, made in orders if field == k % 3 and made <= at <= made + dt.timedelta(days=30)]
    assert sorted(got) == sorted(by_id + by_time) and len(by_time) > 50
    assert spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == before
    kinds = {f.rsplit(".", 1)[-1] for _, _, files in os.walk(roots[0].replace("/out", "/state/state")) for f in files if not f.startswith(".")}
    assert "changelog" in kinds and "delta" not in kinds


def test_links_do_not_end_with_a_batch_that_only_deletes(spark, tmp_path, monkeypatch):
    for name, rows, schema in (
        ("orders", [(k, 1, dt.datetime(2024, 1 + k % 9, 3)) for k in range(20)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        ("lineitem", [(k, 2, dt.datetime(2024, 1 + k % 9, 9), "A", 1.0) for k in range(20)], "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_returnflag string, l_quantity double"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "made" / name))
        [part] = (tmp_path / "made" / name).glob("*.parquet")
        os.link(part, tmp_path / f"{name}.parquet")
    orders = streams.file_stream(spark, str(tmp_path), "orders").selectExpr("o_orderkey AS id", "o_custkey AS field_id", "cast(o_orderdate AS timestamp) AS predicted_at")
    lines = streams.file_stream(spark, str(tmp_path), "lineitem").selectExpr(
        "cast(null AS long) AS prediction_id", "1L AS field_id", "cast(l_shipdate AS timestamp) AS observed_at", "'harvest' AS outcome_type"
    )
    with streams.join_state(spark):
        out = streams.run_to_files(streams.SO.link_in_horizon(orders, lines), "links", str(tmp_path / "run"))
    assert spark.read.parquet(out).count() == sum(a % 9 == b % 9 for a in range(20) for b in range(20))
    assert len([f for f in os.listdir(tmp_path / "run" / "state" / "offsets") if f.isdigit()]) == 1
