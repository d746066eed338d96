from pyspark.sql import functions as F

from cropspark.llm import exact

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [
    (1, "Alpha beta"), (2, "ALPHA BETA"), (3, "alpha  beta"), (4, None), (5, ""), (6, " "), (7, "Ä"), (8, "ä"), (9, "x" * 100_000),
    (10, "X" * 100_000), (2, "ALPHA BETA"), (None, "alpha beta"), (None, None), (11, "unique"),
]


def groups(rows):
    out = {}
    for i, t in rows:
        out.setdefault((t or "").translate(LOWER), []).append(i)
    return out


def check(found, rows):
    want = groups(rows)
    kept = {}
    for r in found:
        members = [i for i in want[next(t for t in want if r.entry.id in want[t] and r.n == len(want[t]) and r.keep.id == largest(want[t]))]]
        assert r.keep.id == largest(members) and r.n == len(members)
        kept[(r.keep.id, r.n, r.digest)] = kept.get((r.keep.id, r.n, r.digest), 0) + (r.entry == r.keep)
    assert len(found) == len(rows)
    assert sum(kept.values()) == len(want)


def largest(ids):
    return max((i for i in ids if i is not None), default=None)


def test_groups_nulls_ties_and_long_texts(docs_of):
    check(exact.classify(exact.file_based(docs_of(ROWS))).collect(), ROWS)


def test_texts_decide_where_digests_collide(docs_of):
    weak = lambda body: F.length(body).cast("string")
    check(exact.classify(exact.file_based(docs_of(ROWS)), digest=weak).collect(), ROWS)


def test_empty_table(docs_of):
    assert exact.classify(exact.file_based(docs_of([]))).count() == 0
    assert exact.keep_one(docs_of([])).count() == 0


def test_keep_one_returns_all_columns_and_survives_clashing_names(docs_of):
    docs = docs_of(ROWS)
    for name in ("digest", "entry", "keep", "n", "_metadata", "__file"):
        docs = docs.withColumn(name, F.lit(name))
    out = exact.keep_one(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(groups(ROWS))
    assert sorted(r.doc_id for r in rows if (r.text or "").lower() == "alpha beta") == [2]


def test_a_state_takes_up_new_rows_only(spark, docs_of, tmp_path):
    arrivals, state = f"{tmp_path}/arrivals", f"{tmp_path}/state"
    for rows in (ROWS[:4], ROWS[4:]):
        table = exact.file_based(docs_of(rows))
        exact._located(table, "doc_id", "text").select(exact.sha256(F.col("body")).alias("digest"), "entry").write.mode("append").parquet(arrivals)
        exact.take_up(spark, arrivals, state)
    entries = exact.read_state(spark, state).collect()
    assert sorted(r.n for r in entries) == sorted(len(v) for v in groups(ROWS).values())
