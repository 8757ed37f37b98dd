"""Fill-in-the-middle by rotating blocks in place.

A text is prefix, middle and suffix in a row. With a sentinel before each of them in one bytearray,
both target forms are that buffer with two neighbouring blocks exchanged: prefix-suffix-middle
exchanges middle and suffix, suffix-prefix-middle exchanges all before the suffix with the suffix. The
exchange is a rotation by three reversals, and its inverse is the rotation back, so a text is restored
from output and form alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resolvescope.llm.common import arrow_columns, small_batches, text_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Setting:
    """Shares in percent: of texts that are transformed, and of those that put the suffix first."""

    seed: int = 42
    transformed: int = 50
    suffix_first: int = 80


def token_ends(text: np.ndarray) -> np.ndarray:
    """Where each token ends, in bytes: a run without white space with the white space before it, or white space at the end."""
    spaces = SPACES[text]
    ends = np.flatnonzero(~spaces & np.append(spaces[1:], True)) + 1
    return np.append(ends, len(text)) if len(text) and spaces[-1] else ends


def reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverse buffer[start:end] in place."""
    half = (end - start) // 2
    left, right = buffer[start:start + half], buffer[end - half:end][::-1]
    kept = left.copy()
    left[:] = right
    right[:] = kept


def rotate(buffer: np.ndarray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, cut) and [cut, end) in place by three reversals."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def bytes_view(buffer: bytearray) -> np.ndarray:
    return np.frombuffer(buffer, dtype=np.uint8)


def arranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text, cut at bytes ``first`` and ``second``, in the given form (psm or spm)."""
    buffer = bytearray(text)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(bytes_view(buffer), middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restored(output: bytes, form: str) -> bytearray:
    """The text that ``arranged`` (or, if plain, nothing) was applied to.

    No text that is transformed holds a sentinel, and sentinels cannot overlap, so each stands once.
    """
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    start = buffer.index(SUFFIX)
    cut = buffer.index(MIDDLE if form == "psm" else PREFIX)
    rotate(bytes_view(buffer), start, cut, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at:at + len(sentinel)]
    return buffer


def numbers(name: str, seed: int) -> list[int]:
    """Four 32-bit numbers of a document, from a digest of seed and name."""
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def code_points(text: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all but continuation bytes."""
    return int(np.count_nonzero((text & 0xC0) != 0x80))


def transform(text: bytes, name: str, setting: Setting) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, prefix and middle in code points, output) of one text."""
    view = np.frombuffer(text, dtype=np.uint8)
    ends = token_ends(view)
    n = len(ends)
    h1, h2, h3, h4 = numbers(name, setting.seed)
    if not text or h3 % 100 >= setting.transformed or any(sentinel in text for sentinel in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < setting.suffix_first else "psm"
    first, second = (int(ends[c - 1]) if c else 0 for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, form, code_points(view[:first]), code_points(view[first:second]), arranged(text, first, second, form)


ADDED = "n long, form string, prefix_chars long, middle_chars long"


def fill_in_middle(docs: DataFrame, setting: Setting = Setting(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row; no shuffle, one row at a time.

    The cuts lie between tokens and follow from seed and doc_id, so a retried task makes the same ones.
    A null or empty text, one that holds a sentinel and those not drawn stay plain: output is the text, the
    two lengths are null. A null doc_id is drawn as an empty name. Repeated rows stay; rows of one doc_id
    share their draws. Other columns are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).cast("binary").alias("_text"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_name"))

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [transform(t.as_py(), name.as_py(), setting) for t, name in zip(batch.column("_text"), batch.column("_name"))]
            n, form, prefix, middle, output = zip(*made) if made else ((),) * 5
            yield arrow_columns(
                batch, ["doc_id"], n=pa.array(n, pa.int64()), form=pa.array(form, pa.string()), prefix_chars=pa.array(prefix, pa.int64()),
                middle_chars=pa.array(middle, pa.int64()), _output=pa.array(map(bytes, output), pa.binary()))

    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(transformed, f"doc_id {kind}, {ADDED}, _output binary")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("_output").cast("string").alias("output"))


def restore_column(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of; a null form counts as plain."""

    @F.pandas_udf("binary")
    def rebuilt(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([bytes(restored(o, f)) for o, f in zip(outputs, forms)], dtype=object)

    return rebuilt(F.coalesce(output, F.lit("")).cast("binary"), F.coalesce(form, F.lit("plain"))).cast("string")


def digests(made: DataFrame) -> DataFrame:
    """``fill_in_middle`` with the SHA-256 of the output and of the text restored from it in place of the texts."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore_column(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
