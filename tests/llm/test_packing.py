import public_tokenizers
from tokenizers import Tokenizer

from cropspark.llm import packing
from cropspark.llm.queries import public_encoder

import numpy as np
import pytest


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(pieces, texts, capacity):
    """Exact round trip: pieces in order of start give the ids; windows are gapless and within the capacity."""
    want = dict(zip(texts, reference_ids([t or "" for t in texts.values()]), strict=True))
    got, windows = {}, {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    assert set(got) == set(want)
    for doc, parts in got.items():
        parts.sort(key=lambda p: p.start)
        ids = [int(x) for p in parts for x in np.frombuffer(p.ids, dtype="<u4")]
        assert ids == want[doc]
        assert all(p.doc_tokens == len(ids) for p in parts)
        assert [p.start for p in parts] == list(np.cumsum([0, *(p.length for p in parts[:-1])]))
    padding = tokens = 0
    for parts in windows.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *(p.length for p in parts[:-1])]))
        length = sum(p.length for p in parts)
        assert 0 < length <= capacity
        tokens += length
        padding += capacity - length if length & (length - 1) else 0
    return padding / tokens


def test_round_trip_of_a_table(spark, tables):
    docs = tables("documents", "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(packing.pack(docs, public_encoder).collect(), texts, 2048) < 0.01


def test_edge_rows(docs_of):
    texts = {1: None, 2: "", 3: "word", 4: "word " * 30_000, 5: "<|endoftext|> é 漢字 \u0000", None: "no id", 7: "\n \t"}
    docs = docs_of(list(texts.items()))
    check(packing.pack(docs, public_encoder).collect(), texts, 2048)
    assert packing.pack(docs_of([]), public_encoder).count() == 0
    assert len(packing.pack(docs_of([(1, "same"), (1, "same")]), public_encoder).collect()) == 2


def test_encoder_gives_the_ids_of_the_tokenizer_file(tables):
    texts = [r.text for r in tables("documents").collect()] + ["don't  stop\n\n  now's", "１２３ ½ ²", "a" * 3000, " x y", "<|endoftext|>"]
    assert [ids.tolist() + [1] for ids in public_encoder()(texts)] == reference_ids(texts)


def test_differencing_evens_out_the_windows():
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.partition_sizes([8, 7, 6, 5, 4], 2)) == [14, 16]
    sizes = np.random.default_rng(1).integers(1, 400, 300).tolist()
    sums = [sum(sizes[i] for i in w) for w in packing.partition_sizes(sizes, 20)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 20


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_small_capacities_hold(capacity):
    docs = [(i, np.arange(n, dtype=np.uint32)) for i, n in enumerate([1, 5, 200, 3, 64, 63, 65])]
    windows = list(packing.pack_stream(iter(docs), capacity))
    assert all(sum(len(p.ids) for p in w) <= capacity for w in windows)
    assert sum(len(p.ids) for w in windows for p in w) == sum(len(ids) for _, ids in docs)
