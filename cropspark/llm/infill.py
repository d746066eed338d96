"""Fill-in-the-middle order of documents, cut at token counts, over a sparse index of multibyte characters.

A text is kept as UTF-8 bytes. Only its multibyte characters are recorded: the byte where each begins and the bytes it has
beyond one. Between them a position in code points and one in bytes differ by a constant, so a cut is converted by one
binary search and a subtraction; a text of ASCII letters has an empty index. Tokens are runs of ASCII letters and single
other characters; they are counted in blocks, so a long text needs no list of its tokens.

Null text counts as empty; a null id is cut by the digest of "1:". An empty text, a text with one of the three marks in it, and a
share of the others stay plain. Repeated rows are cut alike, each. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropspark.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90  # third digest group, modulo 100
SPM_BELOW = 20  # fourth digest group, modulo 100
BLOCK = 1 << 16

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


class ExceptionIndex:
    """Conversion between code points and bytes of a UTF-8 text, from its multibyte characters alone."""

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)  # bytes where a multibyte character begins
        lead = data[self.at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.before = np.concatenate([[0], np.cumsum(excess)])  # excess bytes before the n-th of them
        self.points = self.at - self.before[:-1]  # their positions in code points

    def to_points(self, byte: int) -> int:
        """Code points before a byte that begins a character, or before the end."""
        return byte - int(self.before[np.searchsorted(self.at, byte, "left")])

    def to_bytes(self, point: int) -> int:
        """Bytes before a code point, or before the end."""
        return point + int(self.before[np.searchsorted(self.points, point, "left")])


class TokenStarts:
    """Bytes where tokens begin, counted block by block; a block's starts are listed only when a cut falls into it."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.upto = np.cumsum([0] + [int(np.count_nonzero(self._marks(a))) for a in range(0, len(data), BLOCK)])

    def _marks(self, a: int) -> np.ndarray:
        part = self.data[a : a + BLOCK]
        letter = _LETTER[part]
        before = np.empty_like(letter)
        before[:1] = _LETTER[self.data[a - 1]] if a else False
        before[1:] = letter[:-1]
        return ~(letter & before) & ((part & 0xC0) != 0x80)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def byte(self, n: int) -> int:
        """Byte where token n begins; the end of the text for n at or above their number."""
        if n >= len(self):
            return len(self.data)
        block = int(np.searchsorted(self.upto, n, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._marks(block * BLOCK))[n - self.upto[block]])


def draws(key: object) -> tuple[int, int, int, int]:
    """The first four groups of eight hexadecimal digits of the digest of the id."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def reorder(raw: bytes, key: object, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple[bytes, int, str, int | None, int | None]:
    """(output, tokens, form, prefix_chars, middle_chars) of a text in UTF-8."""
    data = np.frombuffer(raw, dtype=np.uint8)
    starts = TokenStarts(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(key)
    if not raw or h3 % 100 >= plain_from or any(m in raw for m in _MARKS):
        return raw, n, "plain", None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = starts.byte(first), starts.byte(second)
    index = ExceptionIndex(data)
    prefix_chars = index.to_points(a)
    middle_chars = index.to_points(b) - prefix_chars
    p, s, m = _MARKS
    if h4 % 100 < spm_below:
        return b"".join((s, raw[b:], p, raw[:a], m, raw[a:b])), n, "spm", prefix_chars, middle_chars
    return b"".join((p, raw[:a], s, raw[b:], m, raw[a:b])), n, "psm", prefix_chars, middle_chars


def transform(docs: DataFrame, text: str = "text", id: str = "doc_id", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per document: id, output text, n (tokens), form, prefix_chars, middle_chars."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 256):
                part = [reorder(v.as_py(), k, plain_from, spm_below) for v, k in zip(batch.column(1)[at : at + 256], keys[at : at + 256], strict=True)]
                output, n, form, prefix, middle = zip(*part, strict=True)
                columns = [pa.array(output, pa.binary()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 256], *columns], ["key", "output", "n", "form", "prefix_chars", "middle_chars"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, output binary, n bigint, form string, prefix_chars bigint, middle_chars bigint")
    return out.select(F.col("key").alias(id), F.col("output").cast("string").alias("output"), "n", "form", "prefix_chars", "middle_chars")


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from output and form alone.

    A mark begins with the only angle bracket it has, so none can arise across a cut; the first of each is the real one.
    """
    def parts(first: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(PREFIX) + 1))
        one = F.substring_index(body, first, 1)
        rest = F.substr(body, F.length(one) + len(first) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))


def digest(transformed: DataFrame, id: str = "doc_id") -> DataFrame:
    return transformed.select(
        id,
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )
