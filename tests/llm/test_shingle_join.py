import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropspark.llm import shingle_join
from cropspark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute_force(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i in range(len(rows))), key=str)


def edited(words, rng, share):
    return " ".join(rng.choice(["new", "other", "third"]) + str(rng.random()) if rng.random() < share else w for w in words)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_matches_brute_force(docs_of, width, percent):
    rng = random.Random(width)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([2, 9, 10, 11, 30, 150, 600]))]
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((len(rows), edited(base, rng, rng.choice([0, 0.004, 0.01, 0.03]))))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (905, "one two"), (None, "one"), (907, "w " * 40_000), (908, "w " * 500)]
    got = shingle_join.group(docs_of(rows), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, width, percent)


def test_large_cells_are_compared_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(base, rng, 0.03)) for i in range(60)]
    got = shingle_join.group(docs_of(rows), 1, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, 1, 90)


def test_keep_one(docs_of):
    rows = [(5, "a b c d e f g h i j k l"), (3, "A b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (4, None), (6, None), (None, "a b c d e f g h i j k l"), (9, "x")]
    docs = docs_of(rows)
    for name in ("doc", "row", "id", "cls", "root", "digest"):
        docs = docs.withColumn(name, F.lit(1))
    out = shingle_join.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 6, 9]
    assert shingle_join.keep_one(docs_of([])).count() == 0
    assert shingle_join.group(docs_of([])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(7, 7), (8, 9), (9, 8)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {i: 100 for i in range(101, 141)} | {i: 200 for i in range(201, 260)} | {9: 8}
    assert got == want


def test_the_tree_leaves_out_no_linked_pair():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.random(200) > 0.04], rng.integers(0, 1 << 63, 4, dtype=np.uint64)])) for b in base for _ in range(10)]
    n, points = np.array([len(s) for s in sets]), np.stack([shingle_join.point(s) for s in sets])
    every = np.arange(len(sets))
    got = {tuple(sorted(map(int, p))) for p in shingle_join.tree_pairs(n, points, every, every, every, 80)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert (j, i) in got


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_share_one_of_their_few_cells(percent):
    rng = np.random.default_rng(percent)
    cells = shingle_join.Cells(percent)
    for size in [5, 9, 31, 33, 120, 127, 128, 129, 255, 300, 511, 512, 600]:
        for _ in range(12):
            whole = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            most = size * (100 - percent) // 100  # so many of the union may be missing from one of the two
            gone = rng.permutation(size)[: rng.integers(0, most + 1)]
            cut = rng.integers(0, len(gone) + 1)
            a, b = np.unique(np.delete(whole, gone[:cut])), np.unique(np.delete(whole, gone[cut:]))
            both = len(np.intersect1d(a, b))
            assert 100 * both >= percent * (len(a) + len(b) - both)
            if len(a) == len(b) == both or min(cells.differ(len(a)), cells.differ(len(b))) == 0:
                continue
            x, y = (np.concatenate(cells.keys(s)) for s in (a, b))
            assert len(np.intersect1d(x, y))
    mean = np.mean([sum(map(len, cells.keys(rng.integers(0, 1 << 63, n, dtype=np.uint64)))) / n for n in range(256, 1024, 8)])
    assert mean < (1.8 if percent == 50 else 1.45) * (100 - percent) / percent  # of the shingles that may differ; was 1.7 to 4.4 times


def test_cells_travel_packed_and_only_shared_ones_come_back():
    rng = np.random.default_rng(4)
    cells = np.concatenate([rng.integers(0, 1 << 48, 3_000, dtype=np.uint64), np.repeat(rng.integers(0, 1 << 48, 5, dtype=np.uint64), 4), [7, 7, 7]]).astype(np.uint64)
    classes = np.concatenate([rng.integers(-(1 << 63), 1 << 63, 3_000), np.tile([3, -4, 3, 9], 5), [1, 1, 1]])
    sent = list(shingle_join.pack(cells, classes, 6))
    assert sum(len(c) + len(k) for _, c, k in sent) == 14 * len(cells) and {r for r, _, _ in sent} == set(range(6))
    back = [shingle_join.shared(shingle_join._wide(c), np.frombuffer(k, dtype=np.int64)) for _, c, k in sent]
    got = sorted((int(a), int(b), int(h)) for cell, cls, head in back for a, b, h in zip(cell, cls, head, strict=True))
    assert got == sorted((int(c), k, -4) for c in cells[3_000:3_020:4] for k in (-4, 3, 9))
    assert all(len(x) == 0 for x in shingle_join.shared(cells[:0], classes[:0]))


def test_sets_with_the_same_number_are_numbered_anew(docs_of, monkeypatch):
    marks = shingle_join._marks

    def one_number(*args):
        rows = marks(*args)
        return rows.withColumn("cls", F.lit(5).cast("bigint")) if args[-1] == 0 else rows

    monkeypatch.setattr(shingle_join, "_marks", one_number)
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words here"), (4, "")]
    got = shingle_join.group(docs_of(rows), 3, 90).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_force(rows, 3, 90)


def test_points_keep_large_counts():
    points = [np.arange(64, dtype=np.int32), np.full(64, 70_000, dtype=np.int32)]
    packed = [shingle_join.point_bytes(p) for p in points]
    assert list(map(len, packed)) == [64, 256] and (shingle_join.point_rows(packed) == points).all()
    assert shingle_join.point_rows([]).shape == (0, 64)
