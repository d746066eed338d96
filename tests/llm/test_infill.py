import re

import numpy as np

from cropspark.llm import infill

TEXTS = ["", "a", "plain ascii words, and 12 signs", "é漢字\U0001f600 mixed é text  x", "漢" * 3000, "ab" * 90_000 + "é" + "cd " * 40_000, "\n\t ", "<P> marks <S>"]


def test_index_converts_both_ways():
    for text in TEXTS:
        raw = text.encode()
        index = infill.ExceptionIndex(np.frombuffer(raw, dtype=np.uint8))
        assert len(index.at) == sum(ord(c) > 127 for c in text)
        for point in {0, 1, 2, 3, len(text) // 2, len(text) - 1, len(text)}:
            if 0 <= point <= len(text):
                byte = len(text[:point].encode())
                assert index.to_bytes(point) == byte and index.to_points(byte) == point


def test_token_starts_agree_with_the_pattern():
    for text in TEXTS:
        starts = infill.TokenStarts(np.frombuffer(text.encode(), dtype=np.uint8))
        want = [len(text[: m.start()].encode()) for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text, re.S)]
        assert len(starts) == len(want)
        assert [starts.byte(n) for n in range(0, len(want), 997)] == want[::997]
        assert starts.byte(len(want)) == len(text.encode())


def test_forms_and_round_trip(spark, docs_of):
    rows = [(i, TEXTS[i % len(TEXTS)] or "some text é") for i in range(400)] + [(1000, None), (1001, ""), (None, "text of no id"), (5, "again"), (5, "again")]
    docs = docs_of(rows).selectExpr("*", "'clash' AS output", "'x' AS form", "0 AS n", "1 AS key", "2 AS body")
    out = infill.transform(docs)
    got = out.withColumn("back", infill.restored(out.output, out.form)).collect()
    assert sorted((r.doc_id or -1, r.back) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    forms = {f: sum(r.form == f for r in got) for f in ("plain", "psm", "spm")}
    assert forms["psm"] > forms["spm"] > 20 and forms["plain"] > 60
    for r in got:
        text = r.back
        if r.form == "plain":
            assert r.output == text and r.prefix_chars is None and r.middle_chars is None
            continue
        prefix, middle, suffix = text[: r.prefix_chars], text[r.prefix_chars : r.prefix_chars + r.middle_chars], text[r.prefix_chars + r.middle_chars :]
        assert r.output == (f"<P>{prefix}<S>{suffix}<M>{middle}" if r.form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}")
    assert all(r.form == "plain" for r in got if "<P>" in r.back or not r.back)
    assert infill.digest(infill.transform(docs_of([]))).count() == 0
