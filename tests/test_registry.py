"""The registered queries against their oracle SQL on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from cropspark import queries as registered

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
LEARNED = {"ml08_ml09_publish_and_forecast"}
SAMPLE = [
    "fn18_agg11_hazard", "src02_optical_scan", "join04_label_join", "win05_gap_filled_calendar", "join05_nearest_radar", "top03_triage_queue",
    "job05_src07_farmer_features", "job02_prj01_field_features", "str01_daily_wetness_stream", "prj07_fn31_fn32_result_rows",
    "src10_idempotent_feature_append", "src13_retention_prune", "join16_feature_source", "job09_nightly_run", "agg09_leaf_wetness", "agg10_fn15_severity_totals",
    "agg04_peer_reference_within_fold", "ml01_second_order_boosting", "fn18_agg11_hazard_from_sql", "str03_severity_since_spray_stream",
    "prj05_radar_ablation", "join10_point_in_box", "src18_site_sampling", "ml06_set01_baseline_evaluation", "src06_hourly_scan",
]


def test_every_query_but_the_fitted_ones_has_an_oracle():
    assert set(registered.queries()) - set(registered.oracle_sql()) == LEARNED
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
def test_every_oracle_binds():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in registered.oracle_sql().items():
        assert con.sql(sql).columns, name


def test_names_carry_inventory_ids():
    assert all(re.match(r"(src|fn|win|flt|join|agg|prj|job|top|ml|str|set)\d\d_", n) for n in registered.queries())


def rows(items):
    return sorted((tuple(r) for r in items), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    expected = rel.project(", ".join(f'"{c}"' for c in names)).fetchall()
    assert rows(df.select(*names).collect()) == rows(expected)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
