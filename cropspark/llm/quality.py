"""Quality score by compression: a text is closer to the class whose zstandard dictionary compresses it better.

Two dictionaries are built from whole good and bad labelled texts. A text is cut into blocks, each block is compressed
with either dictionary and once with none, and the compressed sizes are added up over the whole text. The normalised size
difference, with the size under no dictionary against the length, becomes a probability by a logistic regression that is
fitted on labelled texts the dictionaries have not seen.

Null and empty texts have difference 0 and length 0 and get the score of that point. Repeated rows get equal scores. An
empty table gives an empty result. Without labels of both classes the score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

BLOCK_BYTES = 4096
DICTIONARY_BYTES = 65_536
GROUP_BYTES = 8 << 20  # characters of the texts from which a task builds one dictionary
MERGED = 64  # dictionaries that become one, on average
LEVEL = 3
WIDTH = 5  # features of a text


class CompressionClassifier:
    """Dictionaries and calibration; small enough to travel with the tasks (two dictionaries and five weights)."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray):
        self.good, self.bad, self.weights = good, bad, weights
        self._compressors = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_compressors": None}

    def compressors(self) -> list:
        if self._compressors is None:
            self._compressors = [_compressor(d) for d in (self.good, self.bad, b"")]
        return self._compressors

    def features(self, text: str | None) -> tuple[float, ...]:
        return _features((text or "").encode("utf-8", "replace"), self.compressors())

    def score(self, texts) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, len(self.weights) - 1)
        return common.sigmoid(self.weights[0] + x @ self.weights[1:])


def _compressor(dictionary: bytes):
    options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**options)
    prepared = zstandard.ZstdCompressionDict(dictionary)
    prepared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=prepared, **options)


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


def _features(data: bytes, compressors: list) -> tuple[float, ...]:
    good, bad, plain = (sum(len(c.compress(b)) for b in _blocks(data)) for c in compressors)
    difference = (bad - good) / max(good, bad, 1)
    ratio = plain / max(len(data), 1)
    size = min(np.log1p(len(data)) / 8, 1.0)
    return difference, difference * size, max(0.0, 0.35 - ratio), max(0.0, 0.15 - ratio), size


def _dictionary(texts: list[str]) -> bytes:
    return _dictionary_of_blocks([b for t in texts for b in _blocks(t.encode("utf-8", "replace"))])


def _dictionary_of_blocks(blocks: list[bytes]) -> bytes:
    if not blocks:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few texts to choose from: they are the dictionary as they are
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def fit(sample: list[tuple[str, int]], counts: tuple[int, int] | None = None) -> CompressionClassifier:
    """Two of three labelled texts build the dictionaries, the third calibrates; `counts` are the classes' sizes before sampling. For rows in memory."""
    texts = {y: [t for t, label in sample if label == y] for y in (0, 1)}
    build = {y: [t for i, t in enumerate(rows) if i % 3] for y, rows in texts.items()}
    rest = {y: [t for i, t in enumerate(rows) if i % 3 == 0] for y, rows in texts.items()}
    model = CompressionClassifier(_dictionary(build[1]), _dictionary(build[0]), np.zeros(1 + WIDTH))
    calibration = [(t, y) for y in (0, 1) for t in rest[y]]
    x = np.array([model.features(t) for t, _ in calibration]).reshape(-1, WIDTH)
    y = np.array([y for _, y in calibration], dtype=float)
    model.weights = common.to_true_odds(common.fit_logistic(x, y, ridge=1e-2), (len(rest[0]), len(rest[1])), counts)
    return model


def _dictionaries(rows: DataFrame, folder: str) -> tuple[bytes, bytes]:
    """The dictionaries of bad and good texts (y 0 and 1), built from all rows.

    Every task builds dictionaries from at most GROUP_BYTES of texts each. Those of a class are then the texts of the next
    dictionaries, about MERGED at a time, until one is left.
    """
    common.ship(rows.sparkSession)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[str]] = {0: [], 1: []}
        size = {0: 0, 1: 0}

        def flush(y: int) -> pd.DataFrame:
            out = pd.DataFrame({"y": [y], "dictionary": [_dictionary(held[y])]})
            held[y], size[y] = [], 0
            return out

        for batch in batches:
            for t, y in zip(batch["text"], batch["y"], strict=True):
                if size[y] and size[y] + len(t) > GROUP_BYTES:
                    yield flush(y)
                held[y].append(t)
                size[y] += len(t)
        for y in (0, 1):
            if size[y]:
                yield flush(y)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(bytes(d) for d in group["dictionary"])
        return pd.DataFrame({"y": [group["y"].iloc[0]], "dictionary": [parts[0] if len(parts) == 1 else _dictionary_of_blocks([b for d in parts for b in _blocks(d)])]})

    kind = "y int, dictionary binary"
    level = common.written(rows.select("text", "y").mapInPandas(build, kind), "dictionaries", folder)
    while (most := max((int(r["count"]) for r in level.groupBy("y").count().collect()), default=0)) > 1:
        group = F.pmod(F.xxhash64("dictionary"), F.lit(-(-most // MERGED)))
        level = common.written(level.groupBy("y", group.alias("part")).applyInPandas(merge, kind), "dictionaries", folder)
    last = {int(r["y"]): bytes(r["dictionary"]) for r in level.collect()}
    return last.get(0, b""), last.get(1, b"")


def train(docs: DataFrame, labels: DataFrame, keep, per_class: int | None = None) -> CompressionClassifier:
    """Fit on all labelled rows for which `keep` holds: four of six parts build the dictionaries, the others calibrate.

    With `per_class`, on at most so many labelled rows of each class, at the odds of all of them.
    """
    spark = docs.sparkSession
    folder = common.new_folder(spark, "quality")
    rows = common.labelled_rows(docs, labels, "quality", keep, folder, per_class)
    calibrates = F.col("part") % 3 == 0
    bad, good = _dictionaries(rows.where(~calibrates), folder)
    model = CompressionClassifier(good, bad, np.zeros(1 + WIDTH))
    shared = common.broadcast(spark, model)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [np.array(shared.value.features(t), dtype=float) for t in batch["text"]], "y": batch["y"]})

    x = common.written(rows.where(calibrates).select("text", "y").mapInPandas(features, "x array<double>, y int"), "features", folder)
    model.weights = common.fit_logistic_rows(x, WIDTH, ridge=1e-2)
    used = {int(r["y"]): int(r["count"]) for r in x.groupBy("y").count().collect()}
    counts = common.class_counts(docs, labels, "quality", keep)
    model.weights = common.to_true_odds(model.weights, (used.get(0, 0), used.get(1, 0)), counts)
    common.remove(spark, folder)
    return model


def score(docs: DataFrame, model: CompressionClassifier, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, score) of every row; other columns are not read."""
    shared = common.broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "score": shared.value.score(batch["body"])})

    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    out = rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, score double")
    return out.select(F.col("key").alias(id), "score")
