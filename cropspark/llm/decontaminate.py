"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are compared as normalised bytes: A-Z lower-cased, each run of white space one space. The CGK random walk reads a text
from a start: at each step it puts out the current byte and moves on or stays, by a random bit of step and byte, so a few edits
change a few places of the output only. A table samples some places of the walk and hashes them; tables differ in walk, places
and length. Windows start at every word of items and documents, and at every byte of words longer than LONG_WORD, which are texts
written without spaces; an item whose windows leave a table empty is also searched for in whole. A walk ends early where its first
HEAD places are those of no item, which drops no window that would have been found.

A hit names an item and an offset. The item-sized part of the document around it is aligned with the item by bit-parallel edit
distance (exact, free ends in the document), and the pair is a match if the distance is at most MAX_EDITS of the item's length.

The items are a stated query set: they go to the tasks in blocks of at most BLOCK_BYTES of text, one pass over the documents for
each block. Empty and null items match nothing; null and empty documents have no match; items and documents with equal texts or
ids are each reported. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

TABLES = [40, 56, 64, 96, 96, 128]  # steps of the walk in each table; a walk covers about half as many bytes
SAMPLES = 12
HEAD = 5  # sampled places after which a document's walk ends unless an item's walk begins alike
LONG_WORD = 24  # bytes
MAX_EDITS = 0.2
BLOCK_BYTES = 4_000_000
CHUNK_BYTES = 2_000_000
SIEVE = 1 << 20
_SEED = 11


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


class _Table:
    def __init__(self, steps: int, seed: int):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, size=(steps, 256), dtype=np.uint8).astype(np.intp)
        self.places = set(np.sort(rng.choice(np.arange(steps // 8, steps), SAMPLES, replace=False)).tolist())
        self.steps = max(self.places) + 1

    def walk(self, data: np.ndarray, starts: np.ndarray, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, hash of the sampled bytes, hash of the first HEAD of them, place after the last step); data ends in enough
        zero bytes. With a sieve of heads, only the starts whose head it holds are walked to the end."""
        at = starts.astype(np.intp)
        key = head = np.zeros(len(at), dtype=np.uint64)
        sampled = 0
        for step in range(self.steps):
            byte = data.take(at)
            if step in self.places:
                key = (key ^ byte) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                sampled += 1
                if sampled == HEAD:
                    head = key.copy()
                    if heads is not None:
                        near = np.flatnonzero(heads[(key % np.uint64(SIEVE)).astype(np.int64)])
                        starts, at, key, head, byte = starts[near], at[near], key[near], head[near], byte[near]
            at += self.moves[step].take(byte)
        return starts, key, head, at


def _tables() -> list[_Table]:
    return [_Table(steps, _SEED + i) for i, steps in enumerate(TABLES)]


def anchors(data: np.ndarray, end: int) -> np.ndarray:
    """Starts of the windows before `end`: of every word, and every place of a long one; words lie between spaces and zero bytes."""
    edges = np.flatnonzero((data[:end] == 32) | (data[:end] == 0))
    begins, ends = np.concatenate([[0], edges + 1]), np.concatenate([edges, [end]])
    inside = np.zeros(end + 1, dtype=np.int8)
    inside[begins[begins < ends]] = 1
    long = ends - begins > LONG_WORD
    step = np.zeros(end + 1, dtype=np.int8)
    step[begins[long]], step[ends[long]] = 1, -1  # two words do not touch, so no place begins one and ends another
    return np.flatnonzero(inside | np.cumsum(step, dtype=np.int8))


def edit_distance(item: bytes, segment: bytes) -> tuple[int, int, int]:
    """Least edit distance of the item to any part of the segment, with that part's start and end."""
    distance, end = _best_end(item, segment)
    _, back = _best_end(item[::-1], segment[:end][::-1])
    return distance, end - back, end


def _best_end(pattern: bytes, text: bytes) -> tuple[int, int]:
    size = len(pattern)
    places: dict[int, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best, best_end = full, 0, size, size, 0
    for at, c in enumerate(text, 1):
        equal = places.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, best_end = score, at
    return best, best_end


def _sieve(keys: np.ndarray) -> np.ndarray:
    sieve = np.zeros(SIEVE, dtype=bool)
    sieve[(keys % np.uint64(SIEVE)).astype(np.int64)] = True
    return sieve


class ItemIndex:
    """The windows of a block of items in every table."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.items = items
        self.entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.heads: list[np.ndarray] = []
        missing: set[int] = set()
        for table in _tables():
            keys, owner, offset, heads = [], [], [], [np.zeros(0, np.uint64)]
            for n, (_, body) in enumerate(items):
                data = np.frombuffer(body + bytes(max(TABLES) + 8), dtype=np.uint8)
                starts = anchors(data, len(body))
                if len(starts):
                    _, key, head, at = table.walk(data, starts)
                    inside = at <= len(body)
                    heads.append(head[inside])
                    keys.append(key[inside])
                    offset.append(starts[inside])
                    owner.append(np.full(int(inside.sum()), n))
                if not len(starts) or not inside.any():
                    missing.add(n)
            join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            key, owner, offset = join(keys, np.uint64), join(owner, np.int64), join(offset, np.int64)
            order = np.argsort(key, kind="stable")
            self.entries.append((key[order], owner[order], offset[order]))
            self.heads.append(np.unique(np.concatenate(heads)))
        self.whole = sorted(missing)

    def prepare(self) -> None:
        self.tables = _tables()
        self.sieves = [_sieve(key) for key, _, _ in self.entries]
        self.head_sieves = [_sieve(head) for head in self.heads]
        self.automaton = None
        if self.whole:
            self.automaton = ahocorasick.Automaton()
            for n in self.whole:
                word = self.items[n][1].decode("latin-1")
                self.automaton.add_word(word, (*self.automaton.get(word, ()), n))
            self.automaton.make_automaton()

    def candidates(self, data: np.ndarray, end: int) -> np.ndarray:
        """(window, item, offset of the window in the item) of each window that a table finds."""
        starts = anchors(data, end)
        found = []
        for table, heads, sieve, (key, owner, offset) in zip(self.tables, self.head_sieves, self.sieves, self.entries, strict=True):
            if not len(key) or not len(starts):
                continue
            at, own, _, _ = table.walk(data, starts, heads)
            near = np.flatnonzero(sieve[(own % np.uint64(SIEVE)).astype(np.int64)])
            first, last = np.searchsorted(key, own[near], "left"), np.searchsorted(key, own[near], "right")
            size = last - first
            near, first, size = near[size > 0], first[size > 0], size[size > 0]
            if len(near):
                which = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                found.append(np.column_stack([np.repeat(at[near], size), owner[which], offset[which]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), dtype=np.int64)


def _matches(index: ItemIndex, bodies: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, start, end, distance) in normalised bytes; the best of overlapping matches of a pair."""
    offsets = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    joined = b"\0".join(bodies) + bytes(max(TABLES) + 8)
    data = np.frombuffer(joined, dtype=np.uint8)
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    found = index.candidates(data, int(offsets[-1]))
    doc = np.searchsorted(offsets, found[:, 0], "right") - 1
    begin = found[:, 0] - offsets[doc] - found[:, 2]  # where the item would start in its document
    before = (-1, -1, 0)
    for d, n, at in np.unique(np.column_stack([doc, found[:, 1], begin]), axis=0).tolist():
        item = index.items[n][1]
        slack = int(MAX_EDITS * len(item)) + 1
        if before[:2] == (d, n) and at - before[2] < slack // 2:
            continue  # the stretch that the window before led to
        before = (d, n, at)
        low, high = max(0, at - slack), min(len(bodies[d]), at + len(item) + slack)
        if high - low < len(item) - slack:
            continue
        distance, start, stop = edit_distance(item, bodies[d][low:high])
        if distance <= MAX_EDITS * len(item):
            best.setdefault((d, n), []).append((distance, low + start, low + stop))
    if index.automaton:
        for d, body in enumerate(bodies):
            for last, owners in index.automaton.iter(body.decode("latin-1")):
                for n in owners:
                    best.setdefault((d, n), []).append((0, last + 1 - len(index.items[n][1]), last + 1))
    for (d, n), found in best.items():
        taken: list[tuple[int, int]] = []
        for distance, start, stop in sorted(found):
            if all(stop <= a or b <= start for a, b in taken):
                taken.append((start, stop))
                yield d, n, start, stop, distance


def original_span(text: str, body: bytes, start: int, stop: int) -> tuple[int, int]:
    """Code points of the original text for a span of its normalised bytes, at the words that hold its ends."""
    words = [(0, 0)]
    at = 0
    encoded = text.encode("utf-8", "replace")
    for word in encoded.split():
        at = encoded.index(word, at)
        words.append((at, at + len(word)))
        at += len(word)
    first = body[: start + 1].count(b" ", 0, start + 1) if body[start : start + 1] != b" " else body[:start].count(b" ") + 1
    last = body[: max(stop - 1, 0)].count(b" ")
    return len(encoded[: words[first + 1][0]].decode("utf-8", "ignore")), len(encoded[: words[last + 1][1]].decode("utf-8", "ignore"))


def blocks(benchmark: DataFrame, text: str = "text", id: str = "item_id") -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id).alias("key"), F.col(text).alias("body")).toLocalIterator():
        body = normalise(row["body"])
        if not body:
            continue
        block.append((row["key"], body))
        size += len(body)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row for each match: id, item_id, start, end (code points of the document), distance (bytes edited)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"key {kind}, item {item_kind}, start bigint, end bigint, distance bigint"
    out = None
    for block in blocks(benchmark, item_text, item_id):
        found = rows.mapInPandas(_search(common.broadcast(spark, ItemIndex(block))), schema)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.select(F.col("key").alias(id), F.col("item").alias(item_id), "start", "end", "distance")


def _search(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        index.prepare()
        for batch in batches:
            keys, texts = batch["key"].tolist(), batch["body"].tolist()
            rows: list[tuple] = []
            at = 0
            while at < len(keys):
                bodies, size, first = [], 0, at
                while at < len(keys) and size < CHUNK_BYTES:
                    bodies.append(normalise(texts[at]))
                    size += len(bodies[-1])
                    at += 1
                for d, n, start, stop, distance in _matches(index, bodies):
                    span = original_span(texts[first + d], bodies[d], start, stop)
                    rows.append((keys[first + d], index.items[n][0], *span, distance))
            if rows:
                yield _frame(rows)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["key", "item", "start", "end", "distance"])
    for name, place in (("key", 0), ("item", 1)):
        if frame[name].dtype == float:  # a null among whole numbers
            frame[name] = pd.array([None if r[place] is None or r[place] != r[place] else int(r[place]) for r in rows], dtype="Int64")
    return frame


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns of the others as they are."""
    for block in blocks(benchmark):
        docs = docs.where(_clean(common.broadcast(docs.sparkSession, ItemIndex(block)))(F.col(f"`{text}`")))
    return docs


def _clean(shared):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        index.prepare()
        for texts in batches:
            bodies = [normalise(t) for t in texts]
            out, at = np.ones(len(bodies), dtype=bool), 0
            while at < len(bodies):
                first, size = at, 0
                while at < len(bodies) and size < CHUNK_BYTES:
                    size += len(bodies[at])
                    at += 1
                for d, *_ in _matches(index, bodies[first:at]):
                    out[first + d] = False
            yield pd.Series(out)

    return clean
