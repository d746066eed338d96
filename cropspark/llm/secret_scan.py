"""Secret scan: fixed patterns, and character Markov models that tell random strings from ordinary identifiers.

Base spans come from three patterns. Every other run of key characters that is long enough is scored by the log-likelihood
ratio of two order-2 Markov models, one of random strings and one of ordinary identifiers, both trained from labelled
samples: the values that the patterns found (random), the other words of the same texts (ordinary), and random draws from the
usual key alphabets by a fixed seed. A run above the threshold that no base span covers becomes a span of its own kind.

Null and empty texts have no spans. Offsets are code points of the whole text, end exclusive. Repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_VALUE = 6

RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
# Ordinary words of the training texts: shorter than any run that is scored, so no unlabelled secret is learnt as ordinary.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{3,18}(?![A-Za-z0-9+/_=-])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 0.35  # mean log-likelihood ratio of a character
SAMPLE_ROWS = 2_000
WORDS_A_TEXT = 200
DRAWS = 2_000
_CODE = np.full(128, -1, dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
_N = len(ALPHABET)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within each kind."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_VALUE]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


class MarkovRatio:
    """Log-likelihood ratio of order-2 character models over a fixed alphabet."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def _counts(strings: list[str]) -> np.ndarray:
        counts = np.zeros((_N, _N, _N))
        for s in strings:
            c = _codes(s)
            if len(c) > 2:
                np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
        return counts

    @staticmethod
    def _log_probability(counts: np.ndarray) -> np.ndarray:
        """Order 2 smoothed by order 1, that by order 0, that by the uniform distribution."""
        zero = (counts.sum((0, 1)) + 1) / (counts.sum() + _N)
        pair = counts.sum(0)
        one = (pair + 8 * zero) / (pair.sum(1, keepdims=True) + 8)
        return np.log((counts + 8 * one) / (counts.sum(2, keepdims=True) + 8))

    @classmethod
    def fit(cls, random_strings: list[str], ordinary: list[str]) -> MarkovRatio:
        return cls(cls._log_probability(cls._counts(random_strings)) - cls._log_probability(cls._counts(ordinary)))

    def mean(self, s: str) -> float:
        c = _codes(s)
        return float(self.table[c[:-2], c[1:-1], c[2:]].mean()) if len(c) > 2 else 0.0


def _codes(s: str) -> np.ndarray:
    c = _CODE[np.minimum(np.frombuffer(s.encode("utf-32-le", "replace"), dtype=np.uint32), 127).astype(np.int64)]
    return c[c >= 0]


def _draws() -> list[str]:
    rng = np.random.default_rng(20)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), size=int(rng.integers(20, 64)))) for i in range(DRAWS)]


def train(docs: DataFrame, text: str = "text", id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, words_a_text: int = WORDS_A_TEXT) -> MarkovRatio:
    """Fit from at most `sample_rows` texts, chosen by a hash of the id, and at most `words_a_text` of the ordinary words of each, evenly
    spread over it: the documented bounds of the training sample.

    Only what the labels need leaves the executors: the values of the base spans and those words.
    """

    common.ship(docs.sparkSession)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            random_strings, ordinary = [], []
            for body in batch["body"]:
                spans = base_spans(body)
                for start, end, _ in spans:
                    random_strings += RUN.findall(body[start:end])
                words = WORD.findall(outside(body, spans))
                ordinary += words[:: max(1, len(words) // words_a_text)][:words_a_text]
            yield pd.DataFrame({"random": [random_strings], "ordinary": [ordinary]})

    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body")).where(F.length("body") > 0)
    picked = rows.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample_rows)
    rows = rows.join(F.broadcast(picked), "key", "left_semi").select("body").limit(sample_rows)
    found = rows.mapInPandas(label, "random array<string>, ordinary array<string>").collect()
    random_strings = [s for r in found for s in r["random"]]
    return MarkovRatio.fit(random_strings + _draws(), [s for r in found for s in r["ordinary"]])


def outside(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a space in place of each span, in one pass; spans may overlap."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out.append(text[at:start])
        at = max(at, end)
    return " ".join([*out, text[at:]])


def added_spans(text: str, covered: list[tuple[int, int, str]], model: MarkovRatio, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Runs that meet no covered span and look random. Runs and spans are gone through together, in order of their starts."""
    out = []
    ordered = sorted(covered)
    upcoming, reach = 0, 0  # spans that begin before the run's end, and the furthest end of them
    for m in RUN.finditer(text):
        start, end = m.span()
        while upcoming < len(ordered) and ordered[upcoming][0] < end:
            reach = max(reach, ordered[upcoming][1])
            upcoming += 1
        if start < reach:
            continue
        if model.mean(m.group()) >= threshold:
            out.append((start, end, "markov"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan(docs: DataFrame, model: MarkovRatio, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: its id and its spans as an array of (kind, start, end) in order of start, then kind."""
    shared = common.broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for body in batch["body"]:
                body = body or ""
                base = base_spans(body)
                spans = base + added_spans(body, base, shared.value)
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            yield pd.DataFrame({"key": batch["key"], "spans": pd.Series(found, dtype=object)})

    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInPandas(run, f"key {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return out.select(F.col("key").alias(id), "spans")


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts and joined spans of `scan` rows."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        id,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with each span replaced; overlapping spans count as one."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


