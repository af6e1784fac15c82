"""Helpers that the operators share: columns, chunking of texts and stable hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of the words of the contracts: everything but blanks and the five ASCII line and tab controls.
WORD_GAP = r"[\x20\x09-\x0D]+"
U64 = np.uint64
#: Rows of a batch that are worked on, and given back, together.
ROWS_AT_ONCE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def utf8(text_col: Column) -> Column:
    """UTF-8 bytes of a text, none if it is null."""
    return F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))


def word_count(text_col: Column) -> Column:
    """Number of words of a text (null: 0), counted as the starts of runs between gaps."""
    parts = F.split(F.coalesce(text_col, F.lit("")), WORD_GAP)
    edge = (F.element_at(parts, 1) == "").cast("long") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
    return F.size(parts).cast("long") - edge


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS_AT_ONCE`` rows, so that what a task makes of a batch stays small on both sides."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def chunks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters together; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) + 1 if t else 1
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the public splitmix64 generator: spreads each bit of a 64-bit value over all others."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=U64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
