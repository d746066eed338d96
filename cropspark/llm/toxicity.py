"""Toxicity by a noisy channel: disguised words are restored by Viterbi decoding, then the restored words are scored.

A chunk of text (between white space, or a run of single letters) may be disguised by look-alike signs, separators between the
letters, or repeated letters. Each of its signs stands for a set of letters, for nothing, or for a word boundary, at a channel
cost; the lattice of these readings is decoded under a character trigram model of the corpus's words. The cues are words and
word beginnings that are far more frequent in toxic than in other labelled texts; the evidence of a text (weight, number and
density of cues among its restored words) becomes a probability by logistic regression, fitted on texts whose own labels did
not choose the cues.

Null and empty texts have no evidence and get the score of that point. Texts are read whole, whatever their length. Repeated
rows get equal scores; an empty table gives an empty result. Without labels of both classes the score is the smoothed share of
label 1.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

CACHE = 200_000
HELD = 400_000  # words or marks whose counts a task holds before it passes them on
WIDTH = 6  # features of a text
SIEVE = 1 << 24  # bits that tell which marks of clean texts are counted
RIDGE = 0.1

# Fixed look-alike signs and the letters they stand for.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = set(".-_*~'`^, /\\")
COST = {"same": 0.0, "look": 1.0, "dropped sign": 8.0, "dropped separator": 0.5, "space": 0.5, "boundary": 3.0, "repeat": 0.3}

LETTERS = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"[^\W\d_][0-9@$!|+(€£¡.\-_*~'`^/\\]+[^\W\d_]|^[0-9@$!|+(€£¡]+[^\W\d_]{2}|([^\W\d_])\1\1|^(?=.*[^\W\d_])(?=.*[0-9@$|+(€£¡])|^[0-9@$!|+(€£¡.\-_*]*[0-9][0-9@$!|+(€£¡.\-_*]{2,}$")
REPEATED = re.compile(r"(.)\1\1")
EDGES = ".,;:?%*#&\"')"  # signs around a word that stand for no letter
SPACED = re.compile(r"(?<!\S)(?:[^\W\d_]|[0-9@$!|+(€£¡])(?:\s+(?:[^\W\d_]|[0-9@$!|+(€£¡])){3,}(?!\S)")


def trigrams_of(words: Counter) -> Counter:
    """Number of occurrences of every three letters in a row; a space stands for the two boundaries before a word and the one after it."""
    out: Counter = Counter()
    for w, n in words.items():
        padded = f"  {w} "
        for i in range(len(w) + 1):
            out[padded[i : i + 3]] += n
    return out


class LetterModel:
    """Character trigrams with word boundaries over an alphabet of at most 63 letters; other letters count as boundaries."""

    def __init__(self, alphabet: list[str], trigrams: Counter):
        self.code = {c: i + 1 for i, c in enumerate(alphabet[:63])}
        size = 64
        counts = np.zeros((size, size, size))
        for (a, b, c), n in trigrams.items():
            counts[self.code.get(a, 0), self.code.get(b, 0), self.code.get(c, 0)] += n
        single = (counts.sum((0, 1)) + 1) / (counts.sum() + size)
        pair = counts.sum(0)
        double = (pair + 5 * single) / (pair.sum(1, keepdims=True) + 5)
        self.log = np.log((counts + 5 * double) / (counts.sum(2, keepdims=True) + 5)).astype(np.float32)
        self._flat: list[float] = []

    def __getstate__(self):
        return self.__dict__ | {"_flat": []}

    def flat(self) -> list[float]:
        """The logarithms in a list, which is faster to read one by one; made once in every task."""
        if not self._flat:
            self._flat = self.log.ravel().tolist()
        return self._flat

    def decode(self, chunk: str) -> str:
        """The likeliest reading of a disguised chunk, words separated by one space."""
        code, log = self.code, self.flat()
        beams = {(0, 0): (0.0, "")}
        before = ""
        for sign in chunk:
            readings = self._readings(sign, before)
            before = sign
            grown: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in beams.items():
                for letter, cost in readings:
                    if letter == "":
                        state, value, out = (a, b), score - cost, text
                    elif letter == " ":
                        state, value, out = (0, 0), score - cost + (log[a << 12 | b << 6] if b else 0.0), text + (" " if b else "")
                    else:
                        c = code.get(letter, 0)
                        state, value, out = (b, c), score - cost + (log[a << 12 | b << 6 | c] if c else -12.0), text + letter
                    if state not in grown or grown[state][0] < value:
                        grown[state] = (value, out)
            beams = grown
        best = max(((score + (log[a << 12 | b << 6] if b else 0.0), text) for (a, b), (score, text) in beams.items()), default=(0.0, ""))
        return best[1].strip()

    @staticmethod
    def _readings(sign: str, before: str) -> list[tuple[str, float]]:
        if sign.isalpha():
            out = [(sign, COST["same"])]
            if sign == before:
                out.append(("", COST["repeat"]))
            return out
        if sign in SEPARATORS:
            return [("", COST["dropped separator"]), (" ", COST["space" if sign == " " else "boundary"])]
        out = [(letter, COST["look"]) for letter in LOOK_ALIKE.get(sign, "")]
        return [*out, ("", COST["dropped sign"]), (" ", COST["dropped sign"])]


def restore(text: str, model: LetterModel) -> str:
    """The lower-cased text with each disguised chunk in its likeliest reading."""
    text = SPACED.sub(lambda m: model.decode(" ".join(m.group().split())), text.lower())
    return re.sub(r"\S+", lambda m: model.decode(m.group()) if DISGUISED.search(m.group()) else m.group(), text)


def words_of(chunk: str, model: LetterModel) -> list[str]:
    """Plain words of a lower-cased chunk, and the restored ones if it looks disguised."""
    words = LETTERS.findall(chunk)
    return words + model.decode(chunk).split() if DISGUISED.search(chunk) else words


def _marks(word: str) -> list[str]:
    return [word, *(word[:k] + "~" for k in range(4, min(len(word), 10)))]


class _Sizes(dict):
    """Number of words of the chunks seen so far; chunks with a cue are also noted in the model's hits."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model, self.heads = model, model.heads

    def __missing__(self, chunk: str) -> int:
        if chunk.isalpha() and chunk[:4] not in self.heads and not REPEATED.search(chunk):
            self[chunk] = 1
            return 1
        size, value, mark = self.model._chunk(chunk)
        self[chunk] = size
        if value:
            self.model._hits[chunk] = (value, mark)
        return size


class ToxicityModel:
    def __init__(self, letters: LetterModel, cues: dict[str, float], weights: np.ndarray):
        self.letters, self.cues, self.weights = letters, cues, weights
        self.heads = {m[:4].rstrip("~") for m in cues}
        self._sizes, self._hits = _Sizes(self), {}

    def __getstate__(self):
        return {"letters": self.letters, "cues": self.cues, "weights": self.weights, "heads": self.heads}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._sizes, self._hits = _Sizes(self), {}

    def _chunk(self, chunk: str) -> tuple[int, float, str]:
        """Number of words of a chunk, and the strongest cue among its plain and restored words."""
        bare = chunk.strip(EDGES)
        if bare.isalpha() and not REPEATED.search(bare):
            return (1, *self._strongest([bare])) if bare[:4] in self.heads else (1, 0.0, "")
        words = words_of(chunk, self.letters)
        return (max(1, len(words)), *self._strongest(words))

    def _strongest(self, words: list[str]) -> tuple[float, str]:
        cues = self.cues
        return max(((cues[m], m) for w in words if w[:4] in self.heads for m in _marks(w) if m in cues), default=(0.0, ""))

    def _spaced(self, text: str) -> tuple[float, str]:
        """The strongest cue of a run of single letters, at whatever letter it begins."""
        return self._strongest([w[i:] for w in self.letters.decode(" ".join(text.split())).split() for i in range(len(w))])

    def features(self, text: str | None) -> tuple[float, ...]:
        text = (text or "").lower()
        chunks = text.split()
        distinct = set(chunks)
        if len(self._sizes) >= CACHE:
            self._sizes.clear()
            self._hits.clear()
        words = sum(map(self._sizes.__getitem__, chunks))
        found = [(*self._spaced(m.group()), 1) for m in SPACED.finditer(text)] if list(map(len, distinct)).count(1) > 2 else []
        found += [(*self._hits[c], chunks.count(c)) for c in sorted(self._hits.keys() & distinct)]
        hits, weight, top, kinds = 0, 0.0, 0.0, set()
        for value, mark, n in found:
            if value:
                hits, weight, top = hits + n, weight + n * value, max(top, value)
                kinds.add(mark)
        rate = hits / (words + 10)
        return top, np.log1p(weight), np.log1p(100 * rate), np.log1p(len(kinds)), np.log1p(hits), np.log1p(words) / 5

    def score(self, texts) -> np.ndarray:
        x = np.array([self.features(t) for t in texts], dtype=float).reshape(-1, len(self.weights) - 1)
        return common.sigmoid(self.weights[0] + x @ self.weights[1:])


class _Marks(dict):
    """Marks of the words of a chunk, kept for the chunks to come; with `sieve`, a bitmap of SIEVE bits, only those whose bit is set."""

    def __init__(self, letters: LetterModel, sieve: bytes | None = None):
        super().__init__()
        self.letters, self.sieve = letters, sieve

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) >= CACHE // 2:
            self.clear()
        bare = chunk.strip(".,;:?\"'")  # signs that make no chunk a disguised one
        words = [bare] if bare.isalpha() and not REPEATED.search(bare) else words_of(chunk, self.letters)
        found = tuple({m for w in words for m in _marks(w) if self.sieve is None or self._passes(m)})
        if len(chunk) <= 64:
            self[chunk] = found
        return found

    def _passes(self, mark: str) -> int:
        bit = zlib.crc32(mark.encode()) % SIEVE
        return self.sieve[bit >> 3] >> (bit & 7) & 1

    def of(self, text: str) -> set[str]:
        return set().union(*map(self.__getitem__, set(text.lower().split())))


def _cues(toxic: Counter, n_toxic: int, clean: Counter, n_clean: int) -> dict[str, float]:
    """Log-odds of the marks that are significantly more frequent in toxic texts."""
    out = {}
    for mark, a in toxic.items():
        odds = np.log((a + 0.5) / (n_toxic + 1)) - np.log((clean[mark] + 0.5) / (n_clean + 1))
        if a >= 3 and odds > 1.2 and odds * np.sqrt(a) > 4:
            out[mark] = float(odds)
    return out


def fit(sample: list[tuple[str, int]], counts: tuple[int, int] | None = None) -> ToxicityModel:
    """Cues of one half of the labelled texts give the features of the other half, on which the weights are fitted; the final
    cues come from both halves. `counts` are the classes' sizes before sampling. For rows in memory; `train` fits on tables."""
    words: Counter = Counter()
    for t, _ in sample:
        words.update(LETTERS.findall(t.lower()))
    trigrams = trigrams_of(words)
    single: Counter = Counter()
    for t, n in trigrams.items():
        single[t[2]] += n
    letters = LetterModel(sorted(single.keys() - {" "}, key=lambda c: (-single[c], c)), trigrams)
    marks = _Marks(letters)
    halves = [{y: [t for t, label in sample[i::2] if label == y] for y in (0, 1)} for i in (0, 1)]
    found: dict = {(y, i): Counter() for y in (0, 1) for i in (0, 1)}
    for y, i in found:
        for t in halves[i][y]:
            found[y, i].update(marks.of(t))
    models, final = _cue_models(letters, found, {(y, i): len(halves[i][y]) for y in (0, 1) for i in (0, 1)})
    x, y = [], []
    for own in (0, 1):
        for label in (0, 1):
            x += [models[own].features(t) for t in halves[own][label]]
            y += [label] * len(halves[own][label])
    final.weights = common.fit_logistic(np.array(x).reshape(-1, WIDTH), np.array(y, dtype=float), ridge=RIDGE)
    sampled = (sum(len(h[0]) for h in halves), sum(len(h[1]) for h in halves))
    final.weights = common.to_true_odds(final.weights, sampled, counts)
    return final


def _cue_models(letters: LetterModel, found: dict, sizes: dict) -> tuple[list[ToxicityModel], ToxicityModel]:
    """Models without weights: for either half the one with the other half's cues, and the one with the cues of both.

    found has the number of texts with each mark, sizes the number of texts, by (label, half).
    """

    def model(sides: tuple[int, ...]) -> ToxicityModel:
        toxic, clean = (sum((found[y, i] for i in sides), Counter()) for y in (1, 0))
        n_toxic, n_clean = (sum(sizes.get((y, i), 0) for i in sides) for y in (1, 0))
        return ToxicityModel(letters, _cues(toxic, n_toxic, clean, n_clean), np.zeros(1 + WIDTH))

    return [model((1,)), model((0,))], model((0, 1))


def _letter_model(rows: DataFrame, folder: str) -> LetterModel:
    """The letter model of all words; trigrams are counted in the tasks and added up by a shuffle of their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()

        def flush() -> pd.DataFrame:
            out = trigrams_of(words)
            words.clear()
            return pd.DataFrame({"trigram": pd.Series(list(out), dtype=object), "n": pd.Series(list(out.values()), dtype="int64")})

        for batch in batches:
            for t in batch["text"]:
                words.update(LETTERS.findall(t.lower()))
                if len(words) >= HELD:
                    yield flush()
        yield flush()

    common.ship(rows.sparkSession)
    counted = rows.select("text").mapInPandas(run, "trigram string, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    counted = common.written(counted, "trigrams", folder)
    third = F.substring("trigram", 3, 1)
    single = counted.where(third != " ").groupBy(third.alias("letter")).agg(F.sum("n").alias("n"))
    alphabet = [r["letter"] for r in single.orderBy(F.desc("n"), "letter").limit(63).collect()]
    if not alphabet:
        return LetterModel([], Counter())
    known = F.regexp_replace("trigram", f"[^{''.join(alphabet)}]", " ")
    trigrams = Counter({r["known"]: r["n"] for r in counted.groupBy(known.alias("known")).agg(F.sum("n").alias("n")).collect()})
    return LetterModel(alphabet, trigrams)


def _counted_marks(rows: DataFrame, letters: LetterModel, sieve: bytes | None, names: tuple[str, str]) -> DataFrame:
    """(mark, and the number of texts of either half with it) over all rows, counted in the tasks and added up by a shuffle."""
    shared = common.broadcast(rows.sparkSession, (letters, sieve))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = _Marks(*shared.value)
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pd.DataFrame]:
            for half, out in enumerate(found):
                yield pd.DataFrame({"mark": pd.Series(list(out), dtype=object), "half": np.full(len(out), half), "n": pd.Series(list(out.values()), dtype="int64")})
                out.clear()

        for batch in batches:
            for t, half in zip(batch["text"], batch["half"], strict=True):
                found[half].update(marks.of(t))
                if len(found[0]) + len(found[1]) >= HELD:
                    yield from flush()
        yield from flush()

    sums = [F.sum(F.when(F.col("half") == half, F.col("n")).otherwise(0)).alias(name) for half, name in enumerate(names)]
    return rows.select("text", "half").mapInPandas(run, "mark string, half int, n long").groupBy("mark").agg(*sums)


def _sieve(marks: DataFrame) -> bytes:
    """The bitmap of the marks; each 64 bits are put together before they reach the driver, so that it gets SIEVE bits at most."""
    bit = F.crc32(F.col("mark").cast("binary")) % SIEVE
    words = marks.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, CAST(crc32(CAST(mark AS BINARY)) % {SIEVE} % 64 AS INT))").alias("bits"))
    out = np.zeros(SIEVE // 64, dtype="<i8")
    for r in words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        out[r["word"]] = r["bits"]
    return out.tobytes()


def _mark_counts(rows: DataFrame, letters: LetterModel, sizes: dict, folder: str) -> dict:
    """Number of texts with each mark that may be a cue, by (label, half).

    A cue is a mark of three toxic texts at least; in the clean texts no others are counted, but for equal bits of the sieve.
    """
    toxic = _counted_marks(rows.where("y = 1"), letters, None, ("t0", "t1")).where(F.col("t0") + F.col("t1") >= 3)
    toxic = common.written(toxic, "marks", folder)
    clean = _counted_marks(rows.where("y = 0"), letters, _sieve(toxic), ("c0", "c1"))
    counted = toxic.join(clean, "mark", "left").na.fill(0, ["c0", "c1"])
    may = F.lit(False)
    for sides in ((0,), (1,), (0, 1)):
        a, c = (sum((F.col(f"{kind}{i}") for i in sides), F.lit(0)) for kind in "tc")
        n_toxic, n_clean = (sum(sizes.get((y, i), 0) for i in sides) for y in (1, 0))
        odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
        may = may | ((a >= 3) & (odds > 1.19) & (odds * F.sqrt(a) > 3.99))  # a little wider than the bounds of _cues, which decides
    out: dict = {(y, i): Counter() for y in (0, 1) for i in (0, 1)}
    for r in counted.where(may).collect():
        for (y, i), own in out.items():
            own[r["mark"]] = r[f"{'ct'[y]}{i}"]
    return out


def _features_under(rows: DataFrame, models: list[ToxicityModel]) -> DataFrame:
    """(x, y) of every row, by the model of its half."""
    shared = common.broadcast(rows.sparkSession, models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [np.array(shared.value[i].features(t), dtype=float) for t, i in zip(batch["text"], batch["half"], strict=True)]
            yield pd.DataFrame({"x": x, "y": batch["y"]})

    return rows.mapInPandas(run, "x array<double>, y int")


def train(docs: DataFrame, labels: DataFrame, keep, per_class: int | None = None) -> ToxicityModel:
    """Fit on all labelled rows for which `keep` holds, as `fit` does, with its counts and sums formed in the tasks.

    With `per_class`, on at most so many labelled rows of each class, at the odds of all of them.
    """
    spark = docs.sparkSession
    folder = common.new_folder(spark, "toxicity")
    rows = common.labelled_rows(docs, labels, "toxic", keep, folder, per_class)
    rows = rows.select("text", "y", (F.col("part") % 2).alias("half"))
    sizes = {(int(r["y"]), int(r["half"])): int(r["count"]) for r in rows.groupBy("y", "half").count().collect()}
    letters = _letter_model(rows, folder)
    models, final = _cue_models(letters, _mark_counts(rows, letters, sizes, folder), sizes)
    x = common.written(_features_under(rows, models), "features", folder)
    final.weights = common.fit_logistic_rows(x, WIDTH, ridge=RIDGE)
    if per_class is not None:
        sampled = tuple(sum(sizes.get((y, i), 0) for i in (0, 1)) for y in (0, 1))
        final.weights = common.to_true_odds(final.weights, sampled, common.class_counts(docs, labels, "toxic", keep))
    common.remove(spark, folder)
    return final


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, score) of every row; other columns are not read."""
    shared = common.broadcast(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "score": shared.value.score(batch["body"])})

    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    out = rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, score double")
    return out.select(F.col("key").alias(id), "score")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, with all their columns as they are."""
    shared = common.broadcast(docs.sparkSession, model)

    @F.pandas_udf("double")
    def toxic(body: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(body))

    return docs.where(toxic(F.col(text)) < threshold)
