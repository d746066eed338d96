"""The classifiers learn from every labelled row, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark.llm import common, quality, toxicity


@pytest.fixture(scope="module")
def many(spark):
    """4,000 texts of either class; those of the last 500 ids of a class by hash hold words that no other text has."""
    ids = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("y"))
    late = {r.doc_id for y in (0, 1) for r in ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id").desc()).limit(500).collect()}
    words = ["kind people who read old books", "rude people who shout at cats"]
    rare = ["a quiet harbour at dawn", "zorgon screams at midnight"]
    rows = [(i, f"{words[i % 2]} number {i}" + (" " + rare[i % 2] if i in late else ""), i % 2) for i in range(8000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, y int").repartition(3).localCheckpoint()


def test_cues_come_from_all_texts(many):
    model = toxicity.train(many.select("doc_id", "text"), many.select("doc_id", F.col("y").alias("toxic")), F.lit(True))
    assert {"zorgon", "rude"} <= model.cues.keys() and "harbour" not in model.cues
    local = toxicity.fit([(r.text, r.y) for r in many.collect()])
    assert local.cues == model.cues and local.letters.code == model.letters.code
    assert np.array_equal(local.letters.log, model.letters.log)


def test_dictionaries_come_from_all_texts_and_merge(many, monkeypatch):
    monkeypatch.setattr(quality, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(quality, "MERGED", 4)
    model = quality.train(many.select("doc_id", "text"), many.select("doc_id", F.col("y").alias("quality")), F.lit(True))
    assert b"zorgon" in model.good and b"harbour" in model.bad
    good, bad = model.score(["rude people who shout at cats zorgon screams", "kind people who read old books quiet harbour"])
    assert good > 0.9 > 0.1 > bad


def test_weights_of_a_table_are_those_of_its_rows(spark):
    x = np.random.default_rng(1).normal(size=(500, 3))
    y = (x @ [1.0, -2.0, 0.5] + np.random.default_rng(2).normal(size=500) > 0.3).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y int").repartition(5)
    assert np.allclose(common.fit_logistic_rows(rows, 3, ridge=0.1), common.fit_logistic(x, y.astype(float), ridge=0.1), atol=1e-9)
    assert common.fit_logistic_rows(rows.where("y = 1"), 3)[0] > 0 and (common.fit_logistic_rows(rows.where("false"), 3) == 0).all()


def test_labels_of_no_or_one_class_and_repeated_ids(docs_of, spark):
    docs = docs_of([(1, "a"), (1, "a"), (2, None), (3, ""), (None, "b")])
    for rows, share in (([], 0.5), ([(1, 1), (1, 1), (2, 1), (None, 1), (3, None)], 0.75)):
        for operator, label in ((toxicity, "toxic"), (quality, "quality")):
            model = operator.train(docs, spark.createDataFrame(rows, f"doc_id bigint, {label} int"), F.lit(True))
            assert all(0 < r.score < 1 for r in operator.score(docs, model).collect())
            if operator is toxicity:
                assert abs(model.score(["x"])[0] - share) < 1e-9
