import os

import duckdb
import pytest

import __spark_entry__ as entry
from cropspark.llm import common, decontaminate, queries

from test_shingle_join import shingles

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()


def test_stages_on_the_small_tables(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    items = [decontaminate.normalise(r.text) for r in common.table(spark, SF, "benchmark").collect()]
    labels = {r.doc_id: r.toxic for r in common.table(spark, SF, "labels").collect()}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.written(stage(spark, docs, SF), name)
        rows = docs.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            continue
        assert docs.columns == names
        kept = {r.doc_id: r.text for r in rows}
        gone = {i: t for i, t in before.items() if i not in kept}
        assert kept.items() <= before.items()
        if name == "toxicity":
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in kept for i in clean) >= 0.95 * len(clean)
        if name == "exact_dedup":
            assert len(kept) == len({t.lower() for t in kept.values()}) and all(t.lower() in {x.lower() for x in kept.values()} for t in gone.values())
        if name == "ngram_jaccard":
            sets = {i: shingles(t, 5) for i, t in before.items()}
            near = lambda a, b: a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and sets[a]
            assert not any(near(a, b) for a in kept for b in kept if a < b)
            assert all(any(near(i, j) for j in before if j != i) for i in gone)
        if name == "decontamination":
            assert not any(item in decontaminate.normalise(t) for item in items for t in kept.values())
            assert all(any(item[:40] in decontaminate.normalise(t) for item in items) for t in gone.values())
    got = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.start, r.length, r.ids_crc32) for r in rows}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted((tuple(r) for r in rel.project(", ".join(columns)).fetchall()), key=key)


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_other_sessions_need_a_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host", "getCheckpointDir": lambda self: None})()

    with pytest.raises(ValueError):
        common.shared_folder(Cluster())
    assert os.path.basename(common.shared_folder(spark))
