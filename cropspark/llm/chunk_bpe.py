"""BPE encoding that encodes content-defined chunks shared by documents once, and decoding.

A rolling hash over the last bytes cuts a text where its low values fall, so equal passages get equal cuts whatever stands around
them. Chunks of more than one document are told by a bitmap of their digests, whose size is fixed; a chunk marked by accident is only
encoded apart. Each marked chunk is encoded once, and its ids travel to the texts that hold it, together with the stretches between them, which
are encoded as they stand; the bytes of a chunk need not travel, since its ids spell them. Texts without a marked chunk are encoded where they
are read.

A cut may fall inside a token. Each join is repaired: from the last sure boundary before it to the first one behind it the text is
encoded again. A boundary is sure where a single space stands between a printable ASCII byte and an ASCII letter: the pattern
begins a match there in any surroundings, and merges do not cross matches. Where the chunk's own ids have no boundary at
that byte, the next one is tried, so the repaired stretch agrees with its neighbours exactly; without any, the repair grows over the chunk.

Strings of special tokens in a text become their ids, as the tokenizer file's library does. Null text counts as empty: no ids. Null ids and
repeated rows are kept, each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

WINDOW = 16  # bytes of the rolling hash
MEAN_BITS = 8  # one byte in 2^8 is a cut
LEAST, MOST = 64, 2048  # bytes of a chunk, but for the last of a text
MAP_BITS = 27  # the bitmap of shared digests: 16 MB
SLOT_BITS = 15  # bits of one slot of it, as it is gathered
BUSY = 1000  # documents from which a chunk's ids are laid out SALTS times
SALTS = 32
BATCH_BYTES = 4 << 20  # of texts or ids handed on at a time, about
ROWS_A_TASK = 1 << 40

_FACTOR = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_SURE = re.compile(rb"(?<=[!-~])(?= [A-Za-z])")


def _powers(base: int) -> np.ndarray:
    out = np.full(_BLOCK + WINDOW, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 1 << 64))


def _candidates(raw: bytes) -> Iterator[int]:
    """Positions where the hash of the WINDOW bytes before them is low."""
    whole = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, len(raw) - WINDOW, _BLOCK):
        data = whole[at : at + _BLOCK + WINDOW]
        sums = np.cumsum(_BYTE[data] * _UP[: len(data)], dtype=np.uint64)
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * _DOWN[WINDOW : len(data)]
        yield from (np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + at + WINDOW + 1).tolist()


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8, all between characters."""
    out, last = [], 0

    def forced(upto: int) -> None:
        nonlocal last
        while upto - last > MOST:
            last += MOST
            while raw[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)

    for at in _candidates(raw):
        if at - last >= LEAST and at < len(raw) and raw[at] & 0xC0 != 0x80:
            forced(at)
            if at > last:
                out.append(at)
                last = at
    forced(len(raw))
    return [*out, len(raw)] if len(raw) else out


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _bits(digest: bytes) -> tuple[int, int]:
    """The two bits of a digest; both are set for a marked one, so few others look marked."""
    low = (1 << MAP_BITS) - 1
    return int.from_bytes(digest[:4], "big") & low, int.from_bytes(digest[4:8], "big") & low


class Codec:
    """Byte-level BPE of a tokenizer file (json). `pattern` splits a text before the merges, as the file's pre-tokenizer does."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as source:
            content = json.load(source)
        self.special = {t["content"].encode(): t["id"] for t in content["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte_of[c] for c in word): n for word, n in content["model"]["vocab"].items() if word.encode() not in self.special}
        self._encoding = tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = np.full(1 + max([*ranks.values(), *self.special.values()]), b"", dtype=object)
        for piece, n in [*ranks.items(), *self.special.items()]:
            self.pieces[n] = piece
        self.widths = np.fromiter(map(len, self.pieces), dtype=np.int64)
        self.kind = np.uint16 if len(self.pieces) <= 1 << 16 else np.uint32  # as ids travel
        found = sorted(self.special, key=len, reverse=True)
        self._special = re.compile(b"|".join(map(re.escape, found))) if found else None

    def plain(self, raw: bytes) -> np.ndarray:
        """Ids of a stretch without special tokens."""
        return self._encoding.encode_to_numpy(raw.decode()).astype(np.int32)

    def segments(self, raw: bytes) -> Iterator[tuple[int, int, int | None]]:
        """(start, end, id of the special token or None) of the parts of a text."""
        at = 0
        for m in self._special.finditer(raw) if self._special else ():
            if m.start() > at:
                yield at, m.start(), None
            yield m.start(), m.end(), self.special[m.group()]
            at = m.end()
        if at < len(raw):
            yield at, len(raw), None

    def chunks(self, raw: bytes) -> Iterator[tuple[int, int]]:
        for start, end, special in self.segments(raw):
            if special is None:
                last = start
                for cut in cuts(raw[start:end]):
                    yield last, start + cut
                    last = start + cut

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(self.pieces[ids].tolist())


def joined(codec: Codec, parts: list[tuple[bytes, np.ndarray]]) -> list[np.ndarray]:
    """Ids of the parts' whole text, from the ids of each part alone and a repair at each join."""
    out: list[np.ndarray] = []
    open_text = b""  # what the ids in `out` do not cover yet, up to the next part

    def agreed(raw: bytes, starts: np.ndarray, backwards: bool) -> tuple[int, int] | None:
        """The first (or last) sure boundary inside raw that is a boundary of its ids too: (byte, number of ids before it)."""
        if backwards:
            at = len(raw)
            while (at := raw.rfind(b" ", 0, at)) > 0:
                if _SURE.match(raw, at) and starts[i := int(np.searchsorted(starts, at))] == at:
                    return at, i
            return None
        for m in _SURE.finditer(raw):
            if starts[i := int(np.searchsorted(starts, m.start()))] == m.start():
                return m.start(), i
        return None

    for n, (raw, ids) in enumerate(parts):
        starts = np.concatenate([[0], np.cumsum(codec.widths[ids])])
        head = (0, 0) if n == 0 else agreed(raw, starts, False)
        if head is None:
            open_text += raw
            continue
        tail = (len(raw), len(ids)) if n == len(parts) - 1 else agreed(raw, starts, True)
        if tail is None:  # only of the first part: a later one has the boundary of its head
            open_text = raw
            continue
        if open_text or head[0]:
            out.append(codec.plain(open_text + raw[: head[0]]))
        out.append(ids[head[1] : tail[1]])
        open_text = raw[tail[0] :]
    if open_text:
        out.append(codec.plain(open_text))
    return out


#: A part of a text: a special token's id, the digest of a marked chunk, or a stretch of bytes.
Part = tuple[str, int | bytes]


def parts_of(codec: Codec, raw: bytes, marked: Callable[[bytes], bool] | None = None) -> list[Part]:
    """The parts of a text in order; without ``marked`` only special tokens part its stretches."""
    out: list[Part] = []
    for start, end, special in codec.segments(raw):
        if special is not None:
            out.append(("special", special))
            continue
        whole = raw[start:end]
        last = pending = 0
        for cut in cuts(whole) if marked else ():
            digest = _digest(whole[last:cut])
            if marked(digest):
                if pending < last:
                    out.append(("stretch", whole[pending:last]))
                out.append(("chunk", digest))
                pending = cut
            last = cut
        if pending < len(whole):
            out.append(("stretch", whole[pending:]))
    return out


def encode_parts(codec: Codec, parts: list[Part], known: dict[bytes, np.ndarray]) -> np.ndarray:
    """Ids of a text from its parts; ``known`` has the ids of its chunks by digest."""
    out: list[np.ndarray] = []
    run: list[tuple[bytes, np.ndarray]] = []
    for kind, value in parts:
        if kind == "special":
            out += [*joined(codec, run), np.array([value], dtype=np.int32)]
            run = []
        elif kind == "chunk":
            ids = known[value]
            run.append((codec.text(ids), ids))
        else:
            run.append((value, codec.plain(value)))
    out += joined(codec, run)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def _bitmap(marked: DataFrame, column: str) -> np.ndarray:
    """The bits whose numbers from 1 are in the column, as a packed array of 2^MAP_BITS bits; the one thing gathered, of that fixed size."""
    slots = marked.groupBy(F.bitmap_bucket_number(column).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 3), dtype=np.uint8)
    width = 1 << (SLOT_BITS - 3)
    for r in slots.collect():
        at = (r["slot"] - 1) * width
        part = np.frombuffer(r["bits"], dtype=np.uint8)[: len(out) - at]
        out[at : at + len(part)] = part
    return out


def _marked(bitmap: np.ndarray, bits: tuple[int, int]) -> bool:
    return all(int(bitmap[b >> 3]) >> (b & 7) & 1 for b in bits)


def shared_chunks(rows: DataFrame, codec: Callable[[], Codec]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the chunks in more than one row, and of those in more than BUSY rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            found = [d for v in batch.column(1) for d in {_digest(raw[a:b]) for raw in [v.as_py()] for a, b in own.chunks(raw)}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    counted = rows.mapInArrow(run, "digest binary").groupBy("digest").count().where(F.col("count") > 1)
    bits = [F.pmod(F.conv(F.hex(F.substring("digest", at, 4)), 16, 10).cast("bigint"), F.lit(1 << MAP_BITS)) + 1 for at in (1, 5)]
    counted = counted.select(F.explode(F.array(*bits)).alias("bit"), (F.col("count") > BUSY).alias("busy"))
    counted = common.written(counted.groupBy("bit").agg(F.max("busy").alias("busy")), "shared-bits")
    return _bitmap(counted, "bit"), _bitmap(counted.where("busy"), "bit")


def encode(docs: DataFrame, codec: Callable[[], Codec], text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: its id and ids, an array of its token ids. `codec` makes the codec in each task."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.col(id).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))
    kind = rows.schema["key"].dataType.simpleString()
    shared, busy = (common.broadcast(spark, b) for b in shared_chunks(rows, codec))
    folder = common.new_folder(spark, "chunk-bpe")

    def is_shared(digest: bytes) -> bool:
        return _marked(shared.value, _bits(digest))

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without a marked chunk, encoded at once."""
        own = codec()
        for batch in batches:
            found, ids = [], []
            for i, v in enumerate(batch.column(1)):
                raw = v.as_py()
                if not any(is_shared(_digest(raw[a:b])) for a, b in own.chunks(raw)):
                    found.append(i)
                    ids.append(encode_parts(own, parts_of(own, raw), {}))
                if len(found) == 256:
                    yield _batch(batch.column(0).take(pa.array(found)), ids)
                    found, ids = [], []
            yield _batch(batch.column(0).take(pa.array(found, pa.int64())), ids)

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other texts in parts, once a batch however many rows have them; a chunk's bytes go with the task's first text that has it."""
        own = codec()
        row = TaskContext.get().partitionId() * ROWS_A_TASK
        told: set[bytes] = set()
        made: list[tuple] = []
        size = 0

        def flushed(kind: pa.DataType) -> pa.RecordBatch:
            rows, keys, parts, chunks, bodies = zip(*made, strict=True)
            columns = [pa.array(rows), pa.array(keys, pa.list_(kind)), pa.array(parts, pa.binary()), pa.array(chunks, _CHUNKS), pa.array(bodies, _BODIES)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, ["row", "keys", "parts", "chunks", "bodies"])

        for batch in batches:
            where: dict[bytes, list[int]] = {}
            for i, v in enumerate(batch.column(1)):
                where.setdefault(v.as_py(), []).append(i)
            for raw, found in where.items():
                parts = parts_of(own, raw, is_shared)
                held = {value for kind, value in parts if kind == "chunk"}
                if not held:
                    continue
                bodies = {d: raw[a:b] for a, b in own.chunks(raw) if (d := _digest(raw[a:b])) in held and d not in told}
                told.update(bodies)
                salt = row % SALTS
                chunks = [{"digest": d, "salt": salt if _marked(busy.value, _bits(d)) else 0} for d in held]
                keys = batch.column(0).take(pa.array(found)).to_pylist()
                made.append((row, keys, pickle.dumps(parts), chunks, [{"digest": d, "body": b} for d, b in bodies.items()]))
                row += 1
                size += len(raw) + 8 * len(keys)
                if size >= BATCH_BYTES:
                    yield flushed(batch.column(0).type)
                    size = 0
            if made:
                yield flushed(batch.column(0).type)
                size = 0

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            digests, salts, ids = [], [], []
            for digest, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = own.plain(body).astype(own.kind).tobytes()
                for salt in range(SALTS if _marked(busy.value, _bits(digest)) else 1):
                    digests.append(digest)
                    salts.append(salt)
                    ids.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(salts, pa.int64()), pa.array(ids, pa.binary())], ["digest", "salt", "ids"])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row first its chunks' ids, then its parts; one text is held at a time."""
        own = codec()
        known: dict[bytes, np.ndarray] = {}
        held: list[tuple[object, np.ndarray]] = []
        size = 0
        for batch in batches:
            kind = batch.column(2).type.value_type
            digests, contents = batch.column(3).to_pylist(), batch.column(4)
            for i, whole in enumerate(batch.column(1).to_pylist()):
                content = contents[i].as_py()
                if not whole:
                    known[digests[i]] = np.frombuffer(content, dtype=own.kind).astype(np.int32)
                    continue
                ids = encode_parts(own, pickle.loads(content), known)
                known = {}
                for key in batch.column(2)[i].as_py():
                    held.append((key, ids))
                    size += 4 * len(ids)
                    if size >= BATCH_BYTES:
                        yield _batch(pa.array([k for k, _ in held], kind), [v for _, v in held])
                        held, size = [], 0
            if held:
                yield _batch(pa.array([k for k, _ in held], kind), [v for _, v in held])
                held, size = [], 0

    schema = f"row bigint, keys array<{kind}>, parts binary, chunks array<struct<digest: binary, salt: bigint>>, bodies array<struct<digest: binary, body: binary>>"
    found = _written(rows.mapInArrow(sharing, schema), f"{folder}/sharing")
    bodies = found.select(F.inline("bodies")).distinct()
    once = _written(bodies.mapInArrow(encoded, "digest binary, salt bigint, ids binary"), f"{folder}/encoded")
    nothing = F.lit(None)
    known = found.select("row", F.inline("chunks")).join(once, ["digest", "salt"]).select(
        "row", F.lit(False).alias("whole"), nothing.cast(f"array<{kind}>").alias("keys"), "digest", F.col("ids").alias("content")
    )
    whole = found.select("row", F.lit(True).alias("whole"), "keys", nothing.cast("binary").alias("digest"), F.col("parts").alias("content"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.unionByName(whole).repartition(partitions, "row").sortWithinPartitions("row", "whole")
    schema = f"key {kind}, ids array<int>"
    return rows.mapInArrow(lone, schema).unionByName(dealt.mapInArrow(assembled, schema)).withColumnRenamed("key", id)


_CHUNKS = pa.list_(pa.struct([("digest", pa.binary()), ("salt", pa.int64())]))
_BODIES = pa.list_(pa.struct([("digest", pa.binary()), ("body", pa.binary())]))


def _written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table of their own; the shuffle files behind them are let go."""
    df.write.option("compression", "zstd").parquet(path)
    spark, schema = df.sparkSession, df.schema
    del df
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def _batch(keys: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
    values = pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32), pa.int32())
    return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, values)], ["key", "ids"])


def decode(encoded: DataFrame, codec: Callable[[], Codec], id: str = "doc_id") -> DataFrame:
    """id, ids and the decoded text; special tokens are written out. Bytes that form no character become U+FFFD; null ids give null."""
    common.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            column = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = column[at : at + 256]
                texts = [own.text(v.values.to_numpy()).decode("utf-8", "replace") if v.is_valid else None for v in part]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], part, pa.array(texts, pa.string())], ["key", "ids", "text"])

    rows = encoded.select(F.col(id).alias("key"), "ids")
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>, text string").withColumnRenamed("key", id)


def digest(decoded: DataFrame, id: str = "doc_id") -> DataFrame:
    return decoded.select(
        id,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
