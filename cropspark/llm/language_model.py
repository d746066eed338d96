"""Log-bilinear language model with noise-contrastive estimation, and token scores under it.

Tokens are words between ASCII white space after lower-casing A-Z, and one end per text. Word counts come from all training
texts, by map-side partial aggregates over 64-bit word hashes. The model predicts symbols: the words of at least a 64th of all
tokens each (so at most 64), the end, and classes of all other words, found by clustering word endings by their neighbours. A
symbol's probability given the symbols before it is log-bilinear: position-wise scaled context vectors are added up and
multiplied with every symbol's vector, in batched matrix products, and normalised over all symbols. A word of a class has the
class's probability times its smoothed share of the class.

All training texts are gathered: the noise distribution comes from the word counts, the neighbours of the endings from partial
sums of each task, and the vectors are trained in numpy by noise-contrastive estimation over all partitions. A bounded sample of
texts only gives the start; each task carries it on over its own texts, and the tasks' vectors are averaged, each symbol's by the
number of times a task has seen it.

Counts of words that make up at least 1 / HEAVY of all tokens (so at most HEAVY of them) go to the tasks as two arrays; all other
tokens are looked up by a join on their hash, so no count is left out and no frequent word is a hot key of that join.

Null and empty texts are scored as their end token alone. Without any training text all counts are 0 and the model is uniform.
Repeated rows and ids are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

TOP = 64
HEAVY = 1 << 20
CLASSES = 95
ENDINGS = 4096
CONTEXT = 5
DIMENSIONS = 24
SAMPLE_TEXTS = 1_500
NOISE = 12
EPOCHS = 4
BATCH = 512
PASS_BATCH = 1024
PASS_TOKENS = 1 << 16  # tokens of a task that are shuffled together
PASS_RATE = 0.1
FEATURES = 128
CACHE = 300_000
END, PAD = 0, 1  # symbols; words of their own follow, then classes


def word_hash(word: bytes) -> int:
    """The xxhash64 of Spark for a string of these bytes."""
    value = xxhash.xxh64_intdigest(word, 42)
    return value - (1 << 64) if value >= 1 << 63 else value


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, ending, c) of every word of the texts, as a written table."""
    word = F.explode(F.split(common.ascii_lower(F.col(text)), common.SPACE))
    rows = docs.select(word.alias("word")).where("word != ''")
    last = F.substring(F.col("word").cast("binary"), -3, 3)
    keyed = rows.select(F.xxhash64("word").alias("hash"), F.pmod(F.crc32(last), F.lit(ENDINGS)).cast("int").alias("ending"))
    return common.written(keyed.groupBy("hash", "ending").agg(F.count("*").alias("c")), "word-counts")


class LogBilinear:
    """Vectors of a fitted model; sizes are set by the constants above, not by the corpus, save the heavy words' arrays."""

    def __init__(self, top: np.ndarray, classes: np.ndarray, context: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.top = {int(h): 2 + i for i, h in enumerate(top)}
        self.classes = classes  # class of each ending
        self.context, self.output, self.bias = context, output, bias

    @property
    def first_class(self) -> int:
        return 2 + len(self.top)

    def symbol(self, hash_: int, end: int) -> int:
        own = self.top.get(hash_)
        return own if own is not None else self.first_class + int(self.classes[end])

    def log10(self, symbols: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol of texts laid end to end, each closed by END; contexts stop at a text's beginning."""
        n = len(symbols)
        begun = np.zeros(n, dtype=np.int64)
        begun[1:] = np.where(symbols[:-1] == END, np.arange(1, n), 0)
        begun = np.maximum.accumulate(begun)
        out = np.empty(n)
        for a in range(0, n, 8192):
            b = min(a + 8192, n)
            hidden = np.zeros((b - a, DIMENSIONS), dtype=np.float32)
            at = np.arange(a, b)
            for k in range(1, CONTEXT + 1):
                before = at - k
                hidden += self.context[k - 1][np.where(before >= begun[a:b], symbols[np.maximum(before, 0)], PAD)]
            logits = hidden @ self.output.T + self.bias
            logits -= logits.max(1, keepdims=True)
            own = logits[np.arange(b - a), symbols[a:b]]
            out[a:b] = own - np.log(np.exp(logits).sum(1))
        return out / np.log(10)


def neighbour_counts(texts: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """How often each feature stands within three places of each ending; texts are arrays of endings."""
    column = np.full(ENDINGS + 1, -1, dtype=np.int64)
    column[features] = np.arange(len(features))
    gap = np.full(3, ENDINGS)  # between texts
    own = np.concatenate([x for t in texts for x in (t, gap)]) if texts else gap
    other = column[own]
    near = np.zeros(ENDINGS * FEATURES, dtype=np.int64)
    for k in (1, 2, 3):
        for a, b in ((own[k:], other[:-k]), (own[:-k], other[k:])):
            seen = (b >= 0) & (a < ENDINGS)
            near += np.bincount(a[seen] * FEATURES + b[seen], minlength=len(near))
    return near.reshape(ENDINGS, FEATURES)


def frequent_endings(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts, kind="stable")[:FEATURES]


def cluster_endings(near: np.ndarray) -> np.ndarray:
    """Class of each ending, from the words within three places of it; endings without any are dealt by number."""
    total = near.sum(1)
    share = (near + near.sum(0) / max(near.sum(), 1) * 5) / (total + 5)[:, None]
    profile = np.log(share + 1e-6)
    profile -= profile.mean(0)
    weight = np.sqrt(total)
    u, s, _ = np.linalg.svd(profile * weight[:, None] / max(weight.max(), 1), full_matrices=False)
    place = profile @ _[:12].T
    seen = np.flatnonzero(total > 0)
    classes = np.arange(ENDINGS) % CLASSES
    if len(seen) > CLASSES:
        rng = np.random.default_rng(8)
        centres = place[rng.choice(seen, CLASSES, replace=False, p=total[seen] / total[seen].sum())]
        for _round in range(12):
            distance = (place[seen] ** 2).sum(1)[:, None] - 2 * place[seen] @ centres.T + (centres**2).sum(1)
            nearest = distance.argmin(1)
            for c in range(CLASSES):
                inside = seen[nearest == c]
                if len(inside):
                    centres[c] = np.average(place[inside], axis=0, weights=total[inside])
        classes[seen] = nearest
    return classes


class Weights:
    """What is trained, with the sums of squared steps that set the rate of each number."""

    def __init__(self, size: int, bias: np.ndarray):
        rng = np.random.default_rng(9)
        scale = 0.3 / np.sqrt(DIMENSIONS)
        self.parts = [rng.normal(0, scale, (size, DIMENSIONS)), rng.normal(0, scale, (size, DIMENSIONS)), np.ones((CONTEXT, DIMENSIONS)) / CONTEXT, bias]
        self.grown = [np.full_like(x, 1e-3) for x in self.parts]

    def learn(self, rows: list[np.ndarray], noise: np.ndarray, rate: float, batch: int, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation over texts of symbols, in random order."""
        if not rows:
            return
        vectors, output, position, bias = self.parts
        size = len(bias)
        padded = np.concatenate([np.concatenate([np.full(CONTEXT, PAD), r]) for r in rows])
        first = np.cumsum([0, *(len(r) + CONTEXT for r in rows[:-1])])
        places = np.concatenate([np.arange(a + CONTEXT, a + CONTEXT + len(r)) for a, r in zip(first, rows, strict=True)])
        cumulative, log_noise = np.cumsum(noise), np.log(np.maximum(noise * NOISE, 1e-30))
        order = rng.permutation(places)
        lanes = np.arange(DIMENSIONS)
        add = lambda at, values: np.bincount((at[:, None] * DIMENSIONS + lanes).ravel(), values.ravel(), size * DIMENSIONS).reshape(size, DIMENSIONS)
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            context = padded[own[:, None] - np.arange(1, CONTEXT + 1)]
            seen = vectors[context]  # batch, place, dimension
            hidden = (seen * position).sum(1)
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE)), size - 1)  # shared by the batch
            true = padded[own]
            score = (hidden * output[true]).sum(1) + bias[true] - log_noise[true]
            false = hidden @ output[drawn].T + bias[drawn] - log_noise[drawn]
            pull = (1 - common.sigmoid(score)) / len(own)
            push = -common.sigmoid(false) / len(own)
            g_hidden = pull[:, None] * output[true] + push @ output[drawn]
            g_output = add(true, pull[:, None] * hidden)
            g_bias = np.bincount(true, pull, size)
            np.add.at(g_output, drawn, push.T @ hidden)
            np.add.at(g_bias, drawn, push.sum(0))
            g_vectors = add(context.ravel(), (g_hidden[:, None, :] * position).reshape(-1, DIMENSIONS))
            g_position = np.einsum("bkd,bd->kd", seen, g_hidden)
            for x, g, past in zip(self.parts, (g_vectors, g_output, g_position, g_bias), self.grown, strict=True):
                past += g * g
                x += rate * g / np.sqrt(past)

    def model(self, top: np.ndarray, classes: np.ndarray) -> LogBilinear:
        vectors, output, position, bias = self.parts
        bias = bias.copy()
        bias[PAD] = -50.0
        context = np.stack([vectors * position[k] for k in range(CONTEXT)]).astype(np.float32)
        return LogBilinear(top, classes, context, output.astype(np.float32), bias.astype(np.float32))


def noise_of(counts: np.ndarray) -> np.ndarray:
    noise = (counts + 0.1) / (counts + 0.1).sum()
    noise[PAD] = 0
    return noise / noise.sum()


def start(texts: list[str], top: np.ndarray, classes: np.ndarray, noise: np.ndarray | None = None) -> tuple[Weights, np.ndarray]:
    """Weights trained on a bounded list of texts, and the noise (None: that of these texts)."""
    known = {int(h): 2 + i for i, h in enumerate(top)}
    first = 2 + len(known)
    rows = [np.array([known.get(word_hash(w), first + int(classes[ending(w)])) for w in words(t)] + [END], dtype=np.int64) for t in texts]
    if noise is None:
        noise = noise_of(np.bincount(np.concatenate(rows), minlength=first + CLASSES) if rows else np.zeros(first + CLASSES))
    weights = Weights(first + CLASSES, np.log(np.maximum(noise, 1e-12)))
    rng = np.random.default_rng(9)
    for epoch in range(EPOCHS):
        weights.learn(rows, noise, 0.15 / (1 + epoch), BATCH, rng)
    return weights, noise


def fit(texts: list[str], top: np.ndarray) -> LogBilinear:
    """Train on a bounded list of texts alone; `top` are the hashes of the words that are symbols of their own."""
    ends = [np.array([ending(w) for w in words(t)], dtype=np.int64) for t in texts]
    counts = np.bincount(np.concatenate(ends), minlength=ENDINGS) if ends else np.zeros(ENDINGS)
    classes = cluster_endings(neighbour_counts(ends, frequent_endings(counts)))
    return start(texts, top, classes)[0].model(top, classes)


def _numbers(batches: Iterator[pd.DataFrame], number) -> Iterator[list[np.ndarray]]:
    """The texts' words as numbers, some texts at a time."""
    known: dict[bytes, int] = {}
    for batch in batches:
        for a in range(0, len(batch), 200):
            split = [words(t) for t in batch["body"].iloc[a : a + 200]]
            if len(known) > CACHE:
                known.clear()
            for s in split:
                for w in s:
                    if w not in known:
                        known[w] = number(w)
            yield [np.fromiter(map(known.__getitem__, s), dtype=np.int64, count=len(s)) for s in split]


def all_neighbours(texts: DataFrame, features: np.ndarray) -> np.ndarray:
    """neighbour_counts over all texts; the driver gets at most ENDINGS x FEATURES sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = np.zeros((ENDINGS, FEATURES), dtype=np.int64)
        for ends in _numbers(batches, ending):
            near += neighbour_counts(ends, features)
        own, other = np.nonzero(near)
        yield pd.DataFrame({"own": own, "other": other, "c": near[own, other]})

    sums = texts.mapInPandas(run, "own int, other int, c bigint").groupBy("own", "other").agg(F.sum("c").alias("c")).toPandas()
    near = np.zeros((ENDINGS, FEATURES))
    near[sums["own"], sums["other"]] = sums["c"]
    return near


def carry_on(texts: DataFrame, weights: Weights, top: np.ndarray, classes: np.ndarray, noise: np.ndarray) -> None:
    """Train over all texts: a pass in each task from these weights on, which become the averages."""
    shared = common.broadcast(texts.sparkSession, (weights, {int(h): 2 + i for i, h in enumerate(top)}, classes, noise))
    shapes = [x.shape for x in weights.parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, known, classes, noise = shared.value
        own = Weights(len(noise), first.parts[3])
        own.parts, own.grown = ([x.copy() for x in xs] for xs in (first.parts, first.grown))
        rng = np.random.default_rng(9)
        seen = np.zeros(len(noise))
        rows: list[np.ndarray] = []
        size = 0
        number = lambda w: known.get(word_hash(w), 2 + len(known) + int(classes[ending(w)]))

        def learn():
            own.learn(rows, noise, PASS_RATE, PASS_BATCH, rng)
            seen[:] += np.bincount(np.concatenate(rows), minlength=len(seen))

        for part in _numbers(batches, number):
            rows += [np.append(r, END) for r in part]
            size += sum(len(r) + 1 for r in part)
            if size >= PASS_TOKENS:
                learn()
                rows, size = [], 0
        if rows:
            learn()
        if seen.any():
            each = np.repeat(seen + 1, DIMENSIONS)
            weight = np.concatenate([each, each, np.full(own.parts[2].size, seen.sum()), seen + 1])
            value = np.concatenate([x.ravel() for x in own.parts])
            yield pd.DataFrame({"place": np.arange(len(value)), "total": value * weight, "weight": weight})

    sums = texts.mapInPandas(run, "place int, total double, weight double").groupBy("place").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).toPandas()
    shared.unpersist()
    if len(sums):
        sums = sums.sort_values("place")
        cuts = np.cumsum([int(np.prod(x)) for x in shapes])[:-1]
        weights.parts = [x.reshape(shape) for x, shape in zip(np.split((sums["total"] / sums["weight"]).to_numpy(), cuts), shapes, strict=True)]


class Scorer:
    """A fitted model with the corpus's counts: totals, sums by class, and the heavy words' counts."""

    def __init__(self, model: LogBilinear, tokens: int, distinct: int, ends: int, heavy: np.ndarray, heavy_counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray):
        self.model, self.tokens, self.distinct, self.ends = model, tokens, distinct, ends
        self.heavy, self.heavy_counts = heavy, heavy_counts
        self.class_log = np.log10(class_tokens + 0.5 * (class_words + 1))
        self.base_log = np.log10(tokens + 0.5 * (distinct + 1))
        self._known: dict[bytes, int] = {}
        self._table = np.zeros((0, 3), dtype=np.int64)

    def __getstate__(self):
        return self.__dict__ | {"_known": {}, "_table": np.zeros((0, 3), dtype=np.int64)}

    def _look_up(self, new: list[bytes]) -> None:
        """Symbol, hash, count (-1: not heavy) of words met for the first time."""
        first = len(self._known)
        self._known.update(zip(new, range(first, first + len(new)), strict=True))
        hashes = np.array([word_hash(w) for w in new], dtype=np.int64)
        symbols = np.array([self.model.symbol(int(h), ending(w)) for h, w in zip(hashes, new, strict=True)], dtype=np.int64)
        counts = np.full(len(new), -1, dtype=np.int64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, hashes), len(self.heavy) - 1)
            counts = np.where(self.heavy[at] == hashes, self.heavy_counts[at], -1)
        while len(self._table) < first + len(new):
            self._table = np.concatenate([self._table, np.zeros((max(1024, len(self._table)), 3), dtype=np.int64)])
        self._table[first : first + len(new)] = np.column_stack([symbols, hashes, counts])

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """Per text: n_tokens, known heavy tokens, sums of log10 parts, and the hashes of the words to be looked up by join."""
        if len(self._known) > CACHE:
            self._known.clear()
        split = [words(t) for t in texts]
        self._look_up([w for w in dict.fromkeys(w for s in split for w in s) if w not in self._known])
        table = self._table
        get = self._known.__getitem__
        ids = [np.fromiter(map(get, s), dtype=np.int64, count=len(s)) for s in split]
        symbols = np.concatenate([np.append(table[i, 0], END) for i in ids])
        lengths = np.array([len(i) + 1 for i in ids])
        stops = np.cumsum(lengths)
        log_symbol = np.add.reduceat(self.model.log10(symbols), stops - lengths)
        out = []
        for i, total in zip(ids, log_symbol, strict=True):
            symbol, hashes, count = table[i].T
            heavy = count >= 0
            log_count = np.log10(count[heavy] + 0.5)
            classed = symbol >= self.model.first_class
            share = np.log10(count[heavy & classed] + 0.5).sum() - self.class_log[symbol[classed] - self.model.first_class].sum()
            base = log_count.sum() + np.log10(self.ends + 0.5) - self.base_log * (len(i) + 1)
            out.append((len(i) + 1, int(heavy.sum()) + (self.ends > 0), base, total + share, hashes[~heavy]))
        return pd.DataFrame(out, columns=["n_tokens", "n_known", "base", "score", "rest"])


def train(docs: DataFrame, keep: Column, text: str = "text", id: str = "doc_id", sample_texts: int = SAMPLE_TEXTS) -> tuple[Scorer, DataFrame]:
    """The scorer and the counts table, from the rows for which `keep` holds.

    All of them are counted and trained on; the start of the vectors is fitted on at most `sample_texts` whole texts, chosen by a
    hash of the id. What the driver holds is bounded: at most TOP and HEAVY words, sums by ending and feature, and the vectors.
    """
    chosen = docs.where(keep).select(F.col(id).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    counts = count_words(chosen, "body")
    ends = chosen.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens = n_words + ends
    distinct += ends > 0
    heavy = counts.where(F.col("c") * F.lit(HEAVY) >= F.lit(tokens)).select("hash", "c").toPandas().sort_values("hash")
    top = heavy[heavy["c"] * TOP >= tokens].sort_values(["c", "hash"], ascending=[False, True])
    picked = chosen.select("key").distinct().orderBy(F.xxhash64("key"), "key").limit(sample_texts)
    sample = chosen.join(F.broadcast(picked), chosen["key"].eqNullSafe(picked["key"]), "left_semi").select("body").limit(sample_texts)
    by_ending = np.zeros((3, ENDINGS))  # tokens of all words; tokens and words of those without a symbol of their own
    own = F.col("hash").isin([int(h) for h in top["hash"]]) if len(top) else F.lit(False)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.sum(F.when(~own, F.col("c"))).alias("classed"), F.count(F.when(~own, 1)).alias("n")).collect():
        by_ending[:, r["ending"]] = r["c"], r["classed"] or 0, r["n"]
    texts = chosen.select("body")
    common.ship(docs.sparkSession)
    classes = cluster_endings(all_neighbours(texts, frequent_endings(by_ending[0])))
    class_tokens, class_words = (np.bincount(classes, x, CLASSES) for x in by_ending[1:])
    noise = noise_of(np.concatenate([[ends, 0], top["c"].to_numpy(), class_tokens]))
    weights, _ = start(sorted(r["body"] for r in sample.collect()), top["hash"].to_numpy(), classes, noise)
    carry_on(texts, weights, top["hash"].to_numpy(), classes, noise)
    model = weights.model(top["hash"].to_numpy(), classes)
    scorer = Scorer(model, int(tokens), int(distinct), ends, heavy["hash"].to_numpy(np.int64), heavy["c"].to_numpy(np.int64), class_tokens, class_words)
    return scorer, counts


def score(docs: DataFrame, scorer: Scorer, counts: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score (smoothed unigram), score (the model), both log10 probabilities of the text."""
    shared = common.broadcast(docs.sparkSession, scorer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.iloc[a : a + 200]
                yield pd.concat([part[["key"]].reset_index(drop=True), shared.value.score(part["body"].tolist())], axis=1)

    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, n_known bigint, base double, score double, rest array<bigint>"
    found = common.written(rows.mapInPandas(run, schema).withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = found.select("row", F.explode("rest").alias("hash")).join(counts.select("hash", "c"), "hash", "left")
    value = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    sums = rare.groupBy("row").agg(F.sum(value).alias("log_c"), F.count("c").alias("known"))
    zero = F.coalesce("log_c", F.lit(0.0))
    return found.join(sums, "row", "left").select(
        F.col("key").alias(id),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (F.col("base") + zero).alias("base_score"),
        (F.col("score") + zero).alias("score"),
    )
