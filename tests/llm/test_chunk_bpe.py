import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cropspark.llm import chunk_bpe
from cropspark.llm.queries import public_codec

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ODD = [
    "",
    "a" * 3000 + " b",
    " " * 5000 + "x",
    "漢字かな交じり文" * 500,
    "x y 　 z don't  'll 's  \n\n\t w" * 60,
    "é è ü " * 300,
    "1 2 3 , . ! a b" * 50,
    "<|endoftext|>",
    "one<|endoftext|> two<|endo three",
    "\u0000 null and \U0001f600 smiles " * 40,
]


@pytest.fixture(scope="module")
def codec():
    return public_codec()


def ids_of(texts):
    return [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_joins_are_repaired_wherever_the_cuts_fall(codec, tables):
    draw = random.Random(1)
    for text in [r.text for r in tables("documents").collect()] + ODD:
        if "<|endoftext|>" in text:
            continue
        want = ids_of([text])[0]
        for cuts in (1, 2, 3, 10, 50):
            at = sorted({draw.randrange(len(text) + 1) for _ in range(cuts)} | {0, len(text)})
            parts = [(text[a:b].encode(), codec.plain(text[a:b].encode())) for a, b in zip(at, at[1:])]
            assert [i for p in chunk_bpe.joined(codec, parts) for i in p.tolist()] == want


def test_cuts_follow_the_content():
    passage = " ".join(f"word{i * i}" for i in range(2000)).encode()
    chunks = lambda raw: {raw[a:b] for a, b in zip([0, *chunk_bpe.cuts(raw)], chunk_bpe.cuts(raw))}
    alone, moved = chunks(passage), chunks(b"something else before it. " + passage)
    assert len(alone & moved) >= len(alone) - 3
    for raw in (passage, "漢字" .encode() * 9000, b"a" * 100_000, b"short"):
        ends = chunk_bpe.cuts(raw)
        assert b"".join(raw[a:b] for a, b in zip([0, *ends], ends)) == raw and all(0 < b - a <= chunk_bpe.MOST for a, b in zip([0, *ends], ends))
        assert all(e == len(raw) or raw[e] & 0xC0 != 0x80 for e in ends)
    long = passage * 40  # over several blocks of the rolling hash
    assert len(chunks(long)) < 2 * len(alone) + 10


def test_agrees_with_the_tokenizer_library(spark, tables):
    docs = tables("documents", "sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    encoded = chunk_bpe.encode(docs, public_codec)
    rows = chunk_bpe.digest(chunk_bpe.decode(encoded, public_codec)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: ids for i, ids in zip(texts, ids_of(list(texts.values())), strict=True)}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == {
        (i, len(ids), sha(",".join(map(str, ids))), sha(texts[i])) for i, ids in want.items()
    }
    assert len(rows) == len(texts)


def test_edge_rows(spark, docs_of, monkeypatch):
    shared = "a passage that stands in several documents, with a name and the year 1987. " * 9
    texts = ODD + [shared, "before " + shared + "behind", "Before" + shared, shared + "\nend", "x" + shared + "y" + shared]
    rows = [*enumerate(texts), (None, "no id " + shared), (90, None), (91, shared), (91, shared)]
    monkeypatch.setattr(chunk_bpe, "BUSY", 2)
    docs = docs_of(rows).selectExpr("*", "'clash' AS ids", "1 AS key", "2 AS row", "3 AS body")
    got = chunk_bpe.decode(chunk_bpe.encode(docs, public_codec), public_codec).collect()
    want = [(i, ids, t or "") for (i, t), ids in zip(rows, ids_of([t or "" for _, t in rows]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert chunk_bpe.digest(chunk_bpe.decode(chunk_bpe.encode(docs_of([]), public_codec), public_codec)).count() == 0


def test_decode_of_ids_that_form_no_text(spark):
    rows = spark.createDataFrame([(1, [50256, 160]), (2, []), (3, None)], "doc_id bigint, ids array<int>")
    texts = {r.doc_id: r.text for r in chunk_bpe.decode(rows, public_codec).collect()}
    assert texts == {1: TOKENIZER.decode([50256, 160], skip_special_tokens=False), 2: "", 3: None}
