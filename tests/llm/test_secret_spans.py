import random
import time

import pytest

from cropspark.llm import secret_scan


@pytest.fixture(scope="module")
def model():
    ordinary = ["configuration", "resident_manager", "background-task", "international", "understanding"] * 40
    return secret_scan.MarkovRatio.fit(secret_scan._draws(), ordinary)


def test_added_spans_meet_no_base_span(model):
    draw = random.Random(4)
    pieces = ["password = 'Zk93hfA8slQp2'", "AKIA" + "Q7" * 9, "deadbeef" * 4, "token:" + "x" * 30, "plain words here", "aGVsbG8gd29ybGQhIQ4Zx9", "/a/long/path/of_ordinary_names/in_it"]
    for _ in range(200):
        text = draw.choice(["", " ", "\n", "/"]).join(draw.choice(pieces) for _ in range(draw.randrange(0, 12)))
        base = secret_scan.base_spans(text)
        want = [
            (m.start(), m.end(), "markov")
            for m in secret_scan.RUN.finditer(text)
            if not any(a < m.end() and m.start() < b for a, b, _ in base) and model.mean(m.group()) >= secret_scan.THRESHOLD
        ]
        assert secret_scan.added_spans(text, base, model) == want


def test_text_outside_of_spans():
    text = "0123456789"
    assert secret_scan.outside(text, [(2, 4, "a"), (3, 6, "b"), (8, 10, "c")]) == "01 67 "
    assert secret_scan.outside(text, []) == text


def test_a_long_text_of_keys_takes_time_in_proportion(model):
    line = "password = Zk93hfA8slQp2 and aGVsbG8gd29ybGQhIQ4Zx9qW\n"

    def seconds(n):
        text = line * n
        start = time.perf_counter()
        spans = secret_scan.base_spans(text)
        assert len(secret_scan.added_spans(text, spans, model)) + len(spans) >= n
        secret_scan.outside(text, spans)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 30 * max(seconds(2_000), 0.01)
