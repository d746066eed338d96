"""Packing of tokenised documents into near-equal windows by Karmarkar-Karp multiway differencing.

Each task tokenises its own documents, cuts whole windows off long ones, and gathers the remaining tails into groups of a
fixed number of windows. A group is partitioned by multiway differencing: every tail starts as a partial partition, and the two
with the largest spread are merged with opposing order until one is left. If a window exceeds the capacity, the group is
partitioned again with one window more. A few tails of each group are cut into short pieces, which even the windows out, and
the group's last tail is cut so that the group fills its windows; the rest of it opens the next group. What is left at the end
of a task after whole windows is laid out at powers of two, which need no padding.

Rows are dealt by a hash of id and text and sorted within a task, so a repeated task gives the same windows; groups are bounded,
whatever a task reads. Null texts count as empty: such a document is its end id alone. Null ids are packed like any other.
Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

CAPACITY = 2048
END_ID = 1
WINDOWS = 64  # windows of a group
SLACK = 8  # tokens left free in each window of a group
FILLER_SHARE = 0.2
FILLER = 48
SEQUENCES_A_TASK = 1 << 40


def tokenizer_encoder(path: str, pattern: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts by a byte-level BPE tokenizer file (json); special strings in a text are ordinary text.

    The file's vocabulary is read as merge ranks, which the faster of the two installed BPE libraries takes; the ids are
    those of the file. `pattern` splits a text before the merges, as the byte-level pre-tokenizer does.
    """
    import tiktoken

    with open(path, encoding="utf-8") as source:
        content = json.load(source)
    special = {t["content"] for t in content["added_tokens"]}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(byte_of[c] for c in word): n for word, n in content["model"]["vocab"].items() if word not in special}
    encoding = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [np.array(encoding.encode_ordinary(t), dtype=np.uint32) for t in texts]


def partition_sizes(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of the sizes in each of so many windows of near-equal sums, by multiway differencing."""
    if windows <= 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(windows - 1))]
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, dtype=np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [[] for _ in range(windows - 1)] + [[i]]))
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]  # the fullest window of one meets the emptiest of the other
        members = [x + y if y else x for x, y in zip(in_a, reversed(in_b), strict=True)]
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), ticket, sums, [members[j] for j in order]))
        ticket += 1
    return heap[0][3]


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:at], self.total), _Piece(self.doc, self.start + at, self.ids[at:], self.total)


def pack_group(pieces: list[_Piece], capacity: int) -> list[list[_Piece]]:
    """Windows of a bounded group of pieces; one window more than needed whenever a window would exceed the capacity."""
    total = sum(len(p.ids) for p in pieces)
    target, cut_so_far, parts = FILLER_SHARE * total, 0, []
    for p in sorted(pieces, key=lambda p: len(p.ids)):
        if cut_so_far < target:
            cut_so_far += len(p.ids)
            while len(p.ids) > FILLER:
                head, p = p.cut(FILLER)
                parts.append(head)
        parts.append(p)
    windows = max(1, -(-total // capacity))
    while True:
        placed = partition_sizes([len(p.ids) for p in parts], windows)
        if all(sum(len(parts[i].ids) for i in w) <= capacity for w in placed):
            return [[parts[i] for i in w] for w in placed if w]
        windows += 1


def take(pieces: list[_Piece], tokens: int) -> tuple[list[_Piece], list[_Piece]]:
    """The first so many tokens of the pieces, and the rest."""
    first, rest = [], list(pieces)
    while tokens > 0 and rest:
        p = rest.pop(0)
        if len(p.ids) > tokens:
            p, q = p.cut(tokens)
            rest.insert(0, q)
        tokens -= len(p.ids)
        first.append(p)
    return first, rest


def pack_stream(documents: Iterator[tuple[object, np.ndarray]], capacity: int) -> Iterator[list[_Piece]]:
    """Windows of a stream of (doc, ids); no more than one group is held at a time."""
    group_tokens = WINDOWS * (capacity - min(SLACK, capacity // 64))
    tails: list[_Piece] = []
    held = 0
    for doc, ids in documents:
        piece = _Piece(doc, 0, ids, len(ids))
        while len(piece.ids) >= capacity:
            head, piece = piece.cut(capacity)
            yield [head]
        if len(piece.ids):
            tails.append(piece)
            held += len(piece.ids)
        if held >= group_tokens:
            group, tails = take(tails, group_tokens)
            held -= group_tokens
            yield from pack_group(group, capacity)
    whole = held // capacity
    group, rest = take(tails, whole * (capacity - min(SLACK, capacity // 64)))
    if group:
        yield from pack_group(group, capacity)
    left = sum(len(p.ids) for p in rest)
    while left:
        size = min(1 << (left.bit_length() - 1), capacity)
        window, rest = take(rest, size)
        left -= sum(len(p.ids) for p in window)
        yield window


def pack(docs: DataFrame, encoder: Callable[[], Callable], capacity: int = CAPACITY, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each piece: id, start, ids (little-endian unsigned 32-bit), length, doc_tokens, sequence_id, offset.

    `encoder` makes the encoding function in each task. Only id and text are read.
    """
    spark = docs.sparkSession
    common.ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        first = TaskContext.get().partitionId() * SEQUENCES_A_TASK
        end = np.array([END_ID], dtype=np.uint32)

        def documents():
            for batch in batches:
                for at in range(0, len(batch), 64):
                    part = batch.iloc[at : at + 64]
                    encoded = encode([t or "" for t in part["body"]])
                    yield from zip(part["key"], (np.concatenate([ids.astype(np.uint32), end]) for ids in encoded), strict=True)

        rows: list[tuple] = []
        for n, window in enumerate(pack_stream(documents(), capacity)):
            offset = 0
            for p in window:
                rows.append((p.doc, p.start, p.ids.astype("<u4").tobytes(), len(p.ids), p.total, first + n, offset))
                offset += len(p.ids)
            if len(rows) >= 4000:
                yield _frame(rows)
                rows = []
        if rows:
            yield _frame(rows)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    dealt = rows.repartition(partitions, F.xxhash64("key", "body")).sortWithinPartitions("key", "body")
    out = dealt.mapInPandas(run, f"key {kind}, start bigint, ids binary, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", id)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["key", "start", "ids", "length", "doc_tokens", "sequence_id", "offset"])
    if frame["key"].dtype == float:  # a null among whole numbers
        frame["key"] = pd.array([None if k is None or k != k else int(k) for k, *_ in rows], dtype="Int64")
    return frame


def digest(packed: DataFrame, id: str = "doc_id") -> DataFrame:
    return packed.select(id, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
