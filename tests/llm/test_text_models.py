"""Quality, toxicity and language model: held-out results, defined edge cases, and sums against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark.llm import language_model, quality, queries, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.01"


def labels_of(spark, name):
    return {r.doc_id: r[name] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


@pytest.mark.parametrize(("build", "label", "folds", "left_out", "cut", "least"), [
    (queries.op2_compression_quality, "quality", 4, 2, 0.7, 0.9),
    (queries.op3_noisy_channel_toxicity, "toxic", 5, 0, 0.5, 0.93),
])
def test_held_out_accuracy(spark, build, label, folds, left_out, cut, least):
    rows, truth = build(spark, SF).collect(), labels_of(spark, label)
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == left_out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= least


EDGES = [(1, None), (2, ""), (3, " \n"), (4, "word " * 50_000), (5, "tie"), (5, "tie"), (None, "no id"), (6, "\U0001f600 é")]


def test_scores_are_defined_for_edge_rows_and_empty_tables(docs_of):
    good, bad = ["a fine text about things"] * 9, ["%%% buy *** now !!!"] * 9
    model = quality.fit([(t, 1) for t in good] + [(t, 0) for t in bad])
    toxic = toxicity.fit([(t, 0) for t in good] + [("you stupid idiot thing", 1)] * 9)
    docs = docs_of(EDGES).withColumn("score", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("body", F.lit("clash"))
    for operator, fitted in ((quality, model), (toxicity, toxic)):
        rows = operator.score(docs, fitted).collect()
        assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
        by_id = {}
        for r in rows:
            by_id.setdefault(r.doc_id, set()).add(r.score)
        assert by_id[1] == by_id[2] and all(len(v) == 1 for v in by_id.values())
        assert operator.score(docs_of([]), fitted).count() == 0
    assert toxicity.keep_clean(docs, toxic, 0.5).columns == docs.columns
    assert 0 < quality.fit([]).score([""])[0] < 1 and 0 < toxicity.fit([]).score(["x"])[0] < 1
    assert quality.fit([("good", 1)] * 3).score(["x"])[0] > 0.5


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores_keep_the_odds_of_all_labels_when_the_bound_bites(spark, docs_of, operator, label):
    rows = [(i, "plain words that say nothing of either class") for i in range(400)]  # one text in ten is of class 1
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], f"doc_id bigint, {label} int")
    for bound in (30, 1000):
        model = operator.train(docs_of(rows), labels, F.lit(True), per_class=bound)
        assert abs(model.score([rows[0][1]])[0] - 0.1) < 0.03


def test_the_channel_restores_disguised_words():
    clean = [("the people in this town are kind and they read a lot of books every day", 0)] * 20
    toxic = [("you idiot and moron what a stupid pathetic loser trash worthless scum", 1)] * 20
    model = toxicity.fit(clean + toxic)
    for disguised, plain in {"1d10t": "idiot", "m0r0n": "moron", "stuuuupid": "stupid", "p-a-t-h-e-t-i-c": "pathetic", "$cum": "scum", "l0$er": "loser"}.items():
        assert toxicity.restore(disguised, model.letters) == plain
        assert model.score([f"the {disguised} in this town"])[0] > model.score(["the people in this town"])[0]
    assert model.score(["books and s t u p i d people"])[0] > 0.5 > model.score(["books and kind people"])[0]


def test_the_channel_restores_trailing_all_leet_and_mixed_forms():
    clean = [("the people in this town are kind and they read a lot of books every day", 0)] * 20
    model = toxicity.fit(clean + [("you idiot and moron what a stupid pathetic loser trash worthless scum", 1)] * 20)
    for disguised in ("1d107", "idi07", "idio7", "idio+", "1.d.1.0.7", "i d 1 o t", "i  d\ni o  t"):
        assert toxicity.restore(disguised, model.letters) == "idiot", disguised
        assert model.score([f"books and {disguised} people"])[0] > model.score(["books and kind people"])[0]


def test_language_model_sums_match_brute_force(spark):
    rows = queries.op8_log_bilinear(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    split = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in split.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    gains = []
    for r in rows:
        ws = split[r.doc_id]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(counts[w] > 0 for w in ws), n, held[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        gains.append((r.score - r.base_score, len(ws), r.held_out))
    assert sum(g for g, _, h in gains if h) / sum(k for _, k, h in gains if h) > 0.2


def test_rare_words_are_looked_up_by_join(spark, docs_of, monkeypatch):
    monkeypatch.setattr(language_model, "HEAVY", 4)
    monkeypatch.setattr(language_model, "EPOCHS", 1)
    rows = [(i, "the cat the dog " + f"w{i % 7} " * (i % 5)) for i in range(60)] + EDGES
    docs = docs_of(rows)
    scorer, counts = language_model.train(docs, F.lit(True))
    assert len(scorer.heavy) <= 4
    total = Counter(w for _, t in rows for w in [*(t or "").translate(LOWER).split(), None])
    n, v = sum(total.values()), len(total)
    want = sorted(round(sum(math.log10((total[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").translate(LOWER).split(), None]), 6) for _, t in rows)
    got = language_model.score(docs, scorer, counts).collect()
    assert np.allclose(sorted(r.base_score for r in got), want, atol=1e-5)
    assert language_model.score(docs_of([]), scorer, counts).count() == 0


def test_vectors_and_classes_come_from_all_texts(spark, docs_of):
    half = [(i, "red apple " * 400) for i in range(150)]
    other = [(1000 + i, "blauer himmel " * 400) for i in range(150)]
    docs = docs_of(half + other).repartition(4)
    for sample in (1, 300):
        scorer, counts = language_model.train(docs, F.lit(True), sample_texts=sample)
        assert {int(h) for h in scorer.model.top} == {language_model.word_hash(w) for w in (b"red", b"apple", b"blauer", b"himmel")}
        gains = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in language_model.score(docs, scorer, counts).collect()}
        assert min(gains.values()) > 0.3
    near = language_model.all_neighbours(docs.select(F.col("text").alias("body")), np.arange(128))
    ends = [np.array([language_model.ending(w) for w in language_model.words(r.text)]) for r in docs.collect()]
    assert (near == language_model.neighbour_counts(ends, np.arange(128))).all()


def test_symbol_probabilities_sum_to_one():
    model = language_model.fit(["the cat sat on the mat by the door"] * 30, np.array([language_model.word_hash(b"the")]))
    context = [2, 5, 9]
    size = len(model.bias)
    total = sum(10 ** model.log10(np.array([*context, s, language_model.END]))[3] for s in range(size))
    assert abs(total - 1) < 1e-4


def test_nothing_to_learn_from(docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    scorer, counts = language_model.train(docs, F.lit(False))
    rows = language_model.score(docs, scorer, counts).collect()
    assert scorer.tokens == 0 and all(math.isfinite(r.score) and r.n_known == 0 for r in rows)


def test_hash_is_that_of_spark(spark):
    words = ["a", "é", "漢字", "x" * 300, "***"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h"), F.pmod(F.crc32(F.substring(F.col("w").cast("binary"), -3, 3)), F.lit(4096)).alias("e")).collect()
    assert all(language_model.word_hash(r.w.encode()) == r.h and language_model.ending(r.w.encode()) == r.e for r in rows)
