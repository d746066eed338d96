"""Set-similarity join of word shingles by group-count vectors in an R-tree, and the components of its links.

A document's set of shingles is hashed into groups; the counts of the groups are a point. Two sets whose union is small against
their intersection have points that are near in every part: with sizes up to n, at most n * (1 - t) / t counts differ in all, so
of more parts of the coordinates than that, all but as many are equal. If every set orders its parts in the same way, those with
the most shingles first, two such sets then have an equal one among their first ones, one more than may differ. Equal parts are the
cells of the tree's upper level and become a plain join; below, in cells whose members are not yet connected, points are packed into leaves with the largest
coordinates of each leaf, and the overlap of a query with a leaf is bounded by the summed coordinate minima. Pairs that survive
the bound are verified on their whole sets. Nothing is capped: a cell of any size is tested in full, save pairs that are
connected already.

Most cells have one member, and a set has many cells: they travel once, sorted and packed, to the range that their key lies in, and
only those of several classes come back as rows.

Work follows different sets, not rows: equal sets are one class from the start (a number that the set's digest gives), each member of a
cell is first verified against one representative and then one of those left apart, and only members that this leaves apart are
compared with each other, in blocks of a fixed number of members.

Words are what lies between ASCII white space after lower-casing A-Z. A text with fewer words than a shingle has the whole
sequence as its one shingle; null, empty and blank texts have no shingle and link with nothing. Equal rows and equal ids are kept
apart as rows. A null id is ignored in the minimum of a component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common
from cropspark.llm.components import components

GROUPS = 64  # coordinates of a point
CELL_GROUPS = 256  # groups of one part in the upper level
CLASS_RATIO = 2.0  # sizes in one class differ by less than this factor
SPARE = 4  # one part more for each so many, so that light ones need not be cells
CELL_BITS = 48  # of a cell's key
DEALT = 1 << 19  # cells that one range has on average
PACKED = 1 << 20  # cells that a task packs at a time
SEEN = 1 << 20  # classes whose cells a task knows to be sent
BLOCK = 1_024  # members of a cell that one task compares
LEAF = 16
CHUNK_BYTES = 500_000
ROWS = 500  # documents whose sets a task holds at a time

_RNG = np.random.default_rng(6)
_BYTE = _RNG.integers(0, 1 << 64, size=(64, 256), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 1 << 63, size=64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(bodies: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, by tabulation over bytes and places."""
    joined = b" " + b" ".join(bodies) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    counts = np.cumsum([1, *(len(b) + 1 for b in bodies)])
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in bodies]
    letters = np.flatnonzero(~blank)
    first = np.zeros(len(data), dtype=bool)
    first[starts] = True
    word = np.cumsum(first)[letters] - 1
    place = letters - starts[word]
    values = _BYTE[place % 64, data[letters]]
    far = place >= 64
    if far.any():
        values[far] = _mix(values[far] + place[far].astype(np.uint64) * _MIX)
    hashes = _mix(np.add.reduceat(values, np.searchsorted(letters, starts)))
    bounds = np.searchsorted(starts, counts)
    return [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out: list[np.ndarray] = []
    bodies = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    at = 0
    while at < len(bodies):
        first, size = at, 0
        while at < len(bodies) and (at == first or size + len(bodies[at]) < CHUNK_BYTES):
            size += len(bodies[at])
            at += 1
        for words in _word_hashes(bodies[first:at]):
            k = min(width, len(words))
            if not k:
                out.append(words)
                continue
            total = np.full(len(words) - k + 1, np.uint64(k), dtype=np.uint64)
            for i in range(k):
                total = _mix(total * _MIX + words[i : len(words) - k + 1 + i])
            out.append(np.unique(total))
    return out


class Cells:
    """Size classes, and the parts of the coordinates that sets of a class are cut into."""

    def __init__(self, percent: int):
        self.percent = percent
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * CLASS_RATIO)))

    def differ(self, size: int) -> int:
        """Most shingles in which a set of this size differs from a linked one that is no smaller."""
        return size * (100 - self.percent) // self.percent

    def keys(self, hashes: np.ndarray) -> list[np.ndarray]:
        """Cell keys of a set: of its own size class and, near the lower end, of the one below, whose smaller sets it may link with.

        In a class, so many shingles as its largest set allows may differ, each of them in one part, so linked sets have all but
        so many parts in common. In an order that follows from the parts alone, the first parts of both, one more than may differ
        for this set, then share one. Parts with more shingles come first, since fewer sets agree in them.
        """
        size = len(hashes)
        if self.differ(size) == 0:
            return []  # links of such sizes are equal sets
        own = int(np.searchsorted(self.bounds, size, "right")) - 1
        classes = [own] + ([own - 1] if own and (self.bounds[own] - 1) * 100 >= size * self.percent else [])
        out = []
        for c in classes:
            most = self.differ(self.bounds[c + 1] - 1)
            parts = most + 1 + most // SPARE
            group = hashes % np.uint64(parts * CELL_GROUPS)
            part = (group // np.uint64(CELL_GROUPS)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sums, weights = np.zeros(parts, dtype=np.uint64), np.zeros(parts, dtype=np.uint64)
            present, starts, counts = np.unique(part[order], return_index=True, return_counts=True)
            sums[present] = np.add.reduceat(_mix(group[order] + np.uint64(1)), starts)
            weights[present] = counts
            sums = _mix(sums + weights * _PLACE[1])
            keys = _mix(sums + np.arange(parts, dtype=np.uint64) * _MIX + np.uint64(c << 40)) >> np.uint64(64 - CELL_BITS)
            out.append(keys[np.lexsort((keys, -weights.astype(np.int64)))][: min(most, self.differ(size)) + 1])
        return out


def point(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def point_bytes(counts: np.ndarray) -> bytes:
    """A byte for each count, or four if one of them needs more."""
    return (counts.astype(np.uint8) if counts.max() < 256 else counts).tobytes()


def point_rows(points: Iterable[bytes]) -> np.ndarray:
    """The counts again, one row for each point."""
    rows = [np.frombuffer(p, dtype=np.uint8 if len(p) == GROUPS else np.int32) for p in points]
    return np.array(rows, dtype=np.int32).reshape(-1, GROUPS)


def fine_point(hashes: np.ndarray) -> bytes:
    """Counts of up to 1,024 groups, about as many as the set has members, a byte each; empty if a count needs more."""
    bits = min(10, max(6, len(hashes).bit_length()))
    counts = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: bytes, b: bytes) -> int | None:
    """Summed minima of two fine points, the finer one folded to the groups of the other; None without a bound."""
    if not a or not b:
        return None
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (a, b))
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum())


def digest(hashes: np.ndarray) -> bytes:
    """128 bits of a set, from two independent sums of its mixed hashes and its size."""
    with np.errstate(over="ignore"):
        a = _mix(hashes + _MIX).sum(dtype=np.uint64) if len(hashes) else np.uint64(0)
        b = (_mix(hashes ^ _PLACE[0]) * _PLACE[1]).sum(dtype=np.uint64) if len(hashes) else np.uint64(0)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little") + len(hashes).to_bytes(5, "little")


def number(digest: bytes, salt: int) -> int:
    """64 bits of a digest, the number of the class of its set; other salts give other numbers."""
    a, b = np.frombuffer(digest[:16], dtype=np.uint64)
    with np.errstate(over="ignore"):
        return int(_mix(_mix(np.array([a + np.uint64(salt)])) + b).view(np.int64)[0])


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS]


def _marks(docs: DataFrame, text: str, id: str, width: int, percent: int, salt: int) -> DataFrame:
    cells = Cells(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            sets = shingle_sets(batch["body"].tolist(), width)
            digests = [digest(s) for s in sets]
            keys = [cells.keys(s) for s in sets]
            none = np.zeros(0, dtype=np.uint64)
            yield pd.DataFrame({
                "key": batch["key"].array,
                "digest": digests,
                "cls": [number(d, salt) for d in digests],
                "n": [len(s) for s in sets],
                "cells": [_narrow(np.concatenate([*k, none])).tobytes() for k in keys],
                "point": [point_bytes(point(s)) for s in sets],
                "fine": [fine_point(s) for s in sets],
            })

    rows = docs.select(F.col(id).alias("key"), F.col(text).alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, digest binary, cls bigint, n bigint, cells binary, point binary, fine binary")


def _narrow(keys: np.ndarray) -> np.ndarray:
    """The bytes of each key that are not always zero, one row each."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, : CELL_BITS // 8]


def _wide(data: bytes | np.ndarray) -> np.ndarray:
    """The keys again."""
    narrow = np.frombuffer(data, dtype=np.uint8).reshape(-1, CELL_BITS // 8)
    out = np.zeros((len(narrow), 8), dtype=np.uint8)
    out[:, : CELL_BITS // 8] = narrow
    return out.view(np.uint64).ravel()


def pack(cells: np.ndarray, classes: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, cells, classes) of the pairs, sorted, for every range of keys that has some."""
    order = np.argsort(cells)
    cells, classes = cells[order], classes[order]
    edges = np.searchsorted((cells * np.uint64(ranges)) >> np.uint64(CELL_BITS), np.arange(ranges + 1, dtype=np.uint64))
    for at in np.flatnonzero(np.diff(edges)).tolist():
        own = slice(edges[at], edges[at + 1])
        yield at, _narrow(cells[own]).tobytes(), classes[own].tobytes()


def shared(cells: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, class, least class of the cell), each pair once, of the cells that hold more than one class."""
    if not len(cells):
        return cells, classes, classes
    order = np.argsort(cells)
    cells, classes = cells[order], classes[order]
    same = cells[1:] == cells[:-1]
    several = np.append(same, False) | np.append([False], same)
    cells, classes = cells[several], classes[several]
    order = np.lexsort((classes, cells))
    cells, classes = cells[order], classes[order]
    fresh = np.append([True], (cells[1:] != cells[:-1]) | (classes[1:] != classes[:-1]))[: len(cells)]
    cells, classes = cells[fresh], classes[fresh]
    starts = np.flatnonzero(np.append([True], cells[1:] != cells[:-1])[: len(cells)])  # the cut is for no cells at all
    sizes = np.diff(np.append(starts, len(cells)))
    held = np.repeat(sizes > 1, sizes)
    return cells[held], classes[held], np.repeat(classes[starts], sizes)[held]


def _members(marks: DataFrame, ranges: int) -> DataFrame:
    """(cell, cls, head) of the cells that several classes have; head is the least of them."""

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # equal sets have equal cells, so a task sends those of a class once
        cells, classes, held = [], [], 0

        def flush() -> pd.DataFrame:
            rows = list(pack(_wide(b"".join(cells)), np.concatenate([*classes, np.zeros(0, np.int64)]), ranges))
            cells.clear()
            classes.clear()
            return pd.DataFrame(rows, columns=["range", "cells", "classes"])

        for batch in batches:
            for cls, own in zip(batch["cls"].tolist(), batch["cells"], strict=True):
                if cls in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                cells.append(own)
                classes.append(np.full(len(own) * 8 // CELL_BITS, cls, dtype=np.int64))
                held += len(classes[-1])
                if held >= PACKED:
                    yield flush()
                    held = 0
        yield flush()

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, classes = [], []
        for batch in batches:
            cells += batch["cells"].tolist()
            classes += batch["classes"].tolist()
        cell, cls, head = shared(_wide(b"".join(cells)), np.frombuffer(b"".join(classes), dtype=np.int64))
        for at in range(0, len(cell), 65_536):
            own = slice(at, at + 65_536)
            yield pd.DataFrame({"cell": cell[own].view(np.int64), "cls": cls[own], "head": head[own]})

    sent = marks.where(F.length("cells") > 0).select("cls", "cells").mapInPandas(packed, "range int, cells binary, classes binary")
    return sent.repartition(ranges, "range").mapInPandas(met, "cell bigint, cls bigint, head bigint")


def _classes(docs: DataFrame, text: str, id: str, width: int, percent: int, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, members), written: the numbers of a document's set, of each different set, and of shared cells.

    A class is numbered by 64 bits of its set's digest, so that the cells need not wait for the classes. Should two sets have the
    same number, all are numbered anew. The cells of single sets are let go once the shared ones are known.
    """
    spark, salt = docs.sparkSession, 0
    while True:
        own = f"{folder}/marks-{salt}"
        marks = common.written(_marks(docs, text, id, width, percent, salt), "shingle-marks", own, codec="zstd")
        alike = marks.where("n > 0").groupBy("cls").agg(
            F.min("key").alias("doc"), F.count("*").alias("size"), F.first("n").alias("n"),
            F.first("point").alias("point"), F.first("fine").alias("fine"), F.min("digest").alias("digest"), F.max("digest").alias("other"),
        )
        classes = common.written(alike, "shingle-classes", folder, codec="zstd")
        if classes.where("digest != other").isEmpty():
            break
        common.remove(spark, own)
        salt += 1
    documents = common.written(marks.select("key", "n", F.expr("if(n > 0, cls, null)").alias("cls")), "shingle-documents", folder)
    cells = marks.agg(F.sum(F.length("cells"))).first()[0] or 0
    members = common.written(_members(marks, min(1 << 15, cells * 8 // CELL_BITS // DEALT + 1)), "shingle-cells", folder)
    common.remove(spark, own)
    return documents, classes.drop("other"), members


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            sets = shingle_sets(batch["body"].tolist(), width)
            yield pd.DataFrame({"digest": [digest(s) for s in sets], "hashes": pd.Series([s.view(np.int64) for s in sets], dtype=object)})

    return docs.select(F.col(text).alias("body")).mapInPandas(run, "digest binary, hashes array<bigint>")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, text: str, id: str, width: int, percent: int, folder: str) -> DataFrame:
    """The pairs (u, v) of class numbers whose whole sets link.

    Pairs are first held against the summed minima of their points, those left against the ones of their fine points, which are
    several times as long; texts are fetched only for the classes that are left.
    """
    def fit(batch: pd.DataFrame, most: np.ndarray) -> np.ndarray:
        most = np.minimum(most, np.minimum(batch["nu"], batch["nv"]).to_numpy())
        return (100 * most >= percent * (batch["nu"] + batch["nv"] - most)).to_numpy()

    def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[fit(batch, np.minimum(point_rows(batch["pu"]), point_rows(batch["pv"])).sum(1)), ["u", "v", "nu", "nv"]]

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = [most_shared(x, y) for x, y in zip(batch["fu"], batch["fv"], strict=True)]
            none = np.iinfo(np.int64).max
            yield batch.loc[fit(batch, np.array([none if m is None else m for m in most], dtype=np.int64)), ["u", "v", "nu", "nv"]]

    kept, size, fine = "u bigint, v bigint, nu bigint, nv bigint", classes.select("cls", "n", "point"), classes.select("cls", "fine")
    near = pairs.join(size.toDF("u", "nu", "pu"), "u").join(size.toDF("v", "nv", "pv"), "v").mapInPandas(coarse, kept)
    near = common.written(near, "coarse-pairs", folder)
    near = near.join(fine.toDF("u", "fu"), "u").join(fine.toDF("v", "fv"), "v").mapInPandas(bound, kept)
    near = common.written(near, "near-pairs", folder)
    needed = near.select(F.col("u").alias("cls")).unionByName(near.select(F.col("v").alias("cls"))).distinct()
    needed = common.written(classes.join(needed, "cls").select("cls", "digest", "doc"), "near-classes", folder)
    fetched = common.in_marked_buckets(docs, F.struct(F.col(id).alias("k")), needed, F.struct(F.col("doc").alias("k")))
    sets = _sets(fetched, text, width).join(needed.select("cls", "digest"), "digest").select("cls", "hashes").dropDuplicates(["cls"])
    sets = common.written(sets, "near-sets", folder)
    both = near.join(sets.toDF("u", "hu"), "u").join(sets.toDF("v", "hv"), "v")
    shared = F.size(F.array_intersect("hu", "hv"))
    return both.where(100 * shared >= percent * (F.col("nu") + F.col("nv") - shared)).select("u", "v")


def tree_pairs(n: np.ndarray, points: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Index pairs (one of left, one of right; each pair once) of different components whose points allow a link.

    The right points are packed into leaves by size and coordinates; a leaf keeps the largest value of each coordinate, the
    smallest size, and its component if it is one. A leaf is opened for the queries whose summed minima with it allow a link.
    """
    order = right[np.lexsort([*points[right].T[:4], n[right]])]
    out = []
    for at in range(0, len(order), LEAF):
        leaf = order[at : at + LEAF]
        top, least = points[leaf].max(0), n[leaf].min()
        bound = np.minimum(np.minimum(points[left], top).sum(1), n[left])
        open_ = 100 * bound >= percent * (n[left] + least - bound)
        if (component[leaf] == component[leaf[0]]).all():
            open_ &= component[left] != component[leaf[0]]
        queries = left[open_]
        if not len(queries):
            continue
        most = np.minimum(np.minimum(points[queries][:, None, :], points[leaf][None]).sum(2), np.minimum(n[queries][:, None], n[leaf][None]))
        fit = (100 * most >= percent * (n[queries][:, None] + n[leaf][None] - most)) & (component[queries][:, None] != component[leaf][None])
        i, j = np.nonzero(fit)
        out.append(np.column_stack([queries[i], leaf[j]]))
    return np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)


def group_pairs(rows: pd.DataFrame, percent: int) -> np.ndarray:
    """Pairs of classes, the smaller first, that the groups (cell, i, j) of these sorted rows leave to verify.

    A group of up to two leaves is taken pair by pair, all such groups in one go; a larger one goes through the tree.
    """
    cell, i, j, own = (rows[c].to_numpy() for c in ("cell", "i", "j", "own"))
    cls, n, component = (rows[c].to_numpy() for c in ("cls", "n", "component"))
    points = point_rows(rows["point"])
    starts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    sizes = np.diff(np.append(starts, len(cell)))
    made = []
    for size in np.unique(sizes[sizes <= 2 * LEAF]).tolist():
        a, b = np.triu_indices(size, 1)
        begin = starts[sizes == size][:, None]
        made.append(np.column_stack([(begin + a).ravel(), (begin + b).ravel()]))
    small = np.concatenate(made) if made else np.zeros((0, 2), dtype=np.int64)
    a, b = small.T
    # in a group of two different blocks a pair takes one member of each
    small = small[(component[a] != component[b]) & ((i[a] == j[a]) | (own[a] != own[b]))]
    kept = []
    for at in range(0, len(small), 65_536):
        a, b = small[at : at + 65_536].T
        most = np.minimum(np.minimum(points[a], points[b]).sum(1), np.minimum(n[a], n[b]))
        kept.append(small[at : at + 65_536][100 * most >= percent * (n[a] + n[b] - most)])
    for start, size in zip(starts[sizes > 2 * LEAF], sizes[sizes > 2 * LEAF], strict=True):
        inside = np.arange(start, start + size)
        left, right = (inside, inside) if i[start] == j[start] else (inside[own[inside] == i[start]], inside[own[inside] == j[start]])
        kept.append(tree_pairs(n, points, component, left, right, percent))
    pairs = np.concatenate(kept) if kept else small[:0]
    return np.unique(np.sort(np.column_stack([cls[pairs[:, 0]], cls[pairs[:, 1]]]), axis=1), axis=0)


def _second_stars(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (u, v) of a cell's first member outside its least component with the members of other components."""
    members = cells.join(found.toDF("cls", "root"), "cls", "left").select("cell", "cls", F.coalesce("root", "cls").alias("component"))
    low = members.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    rows = members.join(low, "cell")
    heads = rows.where("component != low").groupBy("cell").agg(F.min(F.struct("cls", "component")).alias("head"))
    return rows.join(heads, "cell").where("component != head.component").select(F.least("head.cls", "cls").alias("u"), F.greatest("head.cls", "cls").alias("v")).distinct()


def _apart(cells: DataFrame, found: DataFrame, classes: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Pairs (u, v) of the same cell that are not connected yet and that the tree leaves over."""
    members = cells.join(found.toDF("cls", "root"), "cls", "left").select("cell", "cls", F.coalesce("root", "cls").alias("component"))
    mixed = members.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    mixed = mixed.where("low != high").select("cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(mixed, "cell").join(classes.select("cls", "n", "point"), "cls")
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "component", "n", "point")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = batch[["cell", "i", "j"]].iloc[-1]
            open_ = ((batch["cell"] == last["cell"]) & (batch["i"] == last["i"]) & (batch["j"] == last["j"])).to_numpy()
            held = batch[open_]  # a group that may go on in the next batch; it has at most two blocks
            if not open_.all():
                yield pd.DataFrame(group_pairs(batch[~open_], percent), columns=["u", "v"])
        if held is not None:
            yield pd.DataFrame(group_pairs(held, percent), columns=["u", "v"])

    dealt = rows.repartition(partitions, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "cls")
    return dealt.mapInPandas(compare, "u bigint, v bigint").distinct()


def join(
    docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id", folder: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links) of the similarity join; their tables lie in `folder`, a new one unless given.

    documents: id, n (set size), cls (class of equal sets, null without words). classes: cls, n, size (rows). links: u, v
    (verified links between different classes, enough of them to connect every linked pair).
    """
    spark = docs.sparkSession
    common.ship(spark)
    folder = folder or common.new_folder(spark, "shingle-join")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents, classes, members = _classes(docs, text, id, width, percent, folder)

    verify = lambda pairs: common.written(_verified(pairs, classes, docs, text, id, width, percent, folder), "links", folder)
    stars = members.where("cls != head").select(F.col("head").alias("u"), F.col("cls").alias("v")).distinct()
    links = verify(stars)
    links = links.unionByName(verify(_second_stars(members.select("cell", "cls"), components(links, folder))))
    links = links.unionByName(verify(_apart(members.select("cell", "cls"), components(links, folder), classes, percent, partitions)))
    return documents.withColumnRenamed("key", id), classes.select("cls", "n", "size", F.col("doc").alias(id)), links


def group(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row for each document: id, n_shingles, component_id (the smallest id that links reach, its own included)."""
    folder = common.new_folder(docs.sparkSession, "shingle-group")
    documents, classes, links = join(docs, width, percent, text, id, folder)
    roots = classes.join(components(links, folder).toDF("cls", "root"), "cls", "left").select("cls", id, F.coalesce("root", "cls").alias("root"))
    least = roots.groupBy("root").agg(F.min(id).alias("component_id"))
    named = roots.join(least, "root").select("cls", "component_id")
    out = documents.join(named, "cls", "left")
    out = common.written(out.select(id, F.col("n").alias("n_shingles"), F.coalesce("component_id", id).alias("component_id")), "shingle-groups")
    common.remove(docs.sparkSession, folder)
    return out


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns; rows without words all stay.

    A null id comes after all others; rows with equal ids are told apart by a row number of their own. Only rows whose hash
    bucket holds a dropped row go through the last join.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = common.written(packed.withColumn("row", F.monotonically_increasing_id()), "shingle-rows", codec="zstd")
    own = rows.select("row", F.col("doc").getField(id).alias("id"), F.col("doc").getField(text).alias("text"))
    folder = common.new_folder(docs.sparkSession, "shingle-keep")
    documents, classes, links = join(own, width, percent, "text", "row", folder)
    roots = components(links, folder).toDF("cls", "root")
    placed = documents.where("cls is not null").join(roots, "cls", "left").select("row", F.coalesce("root", "cls").alias("root"))
    named = placed.join(own.select("row", "id"), "row").select("row", "root", F.struct(F.col("id").isNull(), "id", "row").alias("rank"))
    first = named.groupBy("root").agg(F.min("rank").alias("first"))
    dropped = common.written(named.join(first, "root").where("rank != first").select("row"), "shingle-dropped")
    common.remove(docs.sparkSession, folder)
    key = F.col("row")
    outside = common.in_marked_buckets(rows, key, dropped, key, inside=False)
    inside = common.in_marked_buckets(rows, key, dropped, key).join(dropped, "row", "left_anti")
    return outside.select("doc.*").unionByName(inside.select("doc.*"))
