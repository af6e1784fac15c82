"""Threshold-scaled document fingerprints (operator 8).

A text's shingles are its runs of ``SHINGLE`` code points (a shorter text is its own shingle).  Each
is hashed, and the sketch keeps every distinct hash below a fixed fraction of the hash range.  The threshold
is the same for all texts, so sketches merge by union, and the part of one sketch that lies in another estimates
how much of the first text the second contains, whatever their lengths.  Where no hash of a text that
has shingles falls below the threshold, its smallest stands for them, so short texts can still be told apart.

A fingerprint is the sorted hashes in fixed-width hexadecimal, one after another.

Each document is also compared with its successor in id order.  Rows are dealt by ranges of (id, hash of the text); the
ranges' bounds come from the same narrow rows in order, so rows of one id are split too, and so are rows that repeat.  The first row of each range is sent to the
range before it as well, so that successors meet without ordering the whole table in one task, and texts are shuffled once.

A text with no hash below the threshold is known by its smallest hash alone: such a sketch tells equal texts from others, but
neither merges nor estimates (``containment`` gives None).  With n shingles a likeness of L has a standard error of about
sqrt(SCALE * L * (1 - L) / n); the README has measured ones.

Defined results: null texts are empty; an empty text has an empty fingerprint, and two empty ones are alike
(1.0), one empty and another not are unlike (0.0); rows of one id follow one another in the order of hashes of their
texts; rows without an id come last; a table of one row has itself for a successor; texts of any length are read to their end,
in pieces; an empty table gives an empty result; extra columns are not kept, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import U64, code_points, mix64, powers, table

SHINGLE = 10
#: Hashes have 48 bits; one in ``SCALE`` is kept.
BITS, SCALE = 48, 16
DIGITS = 11
LIMIT = (1 << BITS) // SCALE
MULTIPLIER = 0x2545F4914F6CDD1D
PIECE = 1 << 20
OUT_ROWS = 2_000
RANGE_BYTES = 128 << 20

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Hasher:
    """Hashes of all shingles of code points, by differences of one running polynomial."""

    def __init__(self) -> None:
        self.up = powers(MULTIPLIER, PIECE + SHINGLE + 1)
        self.down = powers(pow(MULTIPLIER, -1, 1 << 64), PIECE + SHINGLE + 1)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        k = min(SHINGLE, n)
        total = np.zeros(n + 1, U64)
        np.cumsum((codes.astype(U64) + U64(1)) * self.up[:n], out=total[1:])
        return mix64((total[k:] - total[:-k]) * self.down[: n - k + 1] + U64(k)) >> U64(64 - BITS)

    def sketch(self, codes: np.ndarray) -> np.ndarray:
        """Sorted distinct hashes below the threshold, of texts of any length."""
        if not len(codes):
            return np.zeros(0, U64)
        kept, least = [], U64(1 << BITS)
        for at in range(0, max(1, len(codes) - SHINGLE + 1), PIECE):
            h = self.hashes(codes[at : at + PIECE + SHINGLE - 1])
            least = min(least, h.min())
            kept.append(h[h < U64(LIMIT)])
        out = np.unique(np.concatenate(kept))
        return out if len(out) else np.array([least], U64)


def spelled(sketch: np.ndarray) -> str:
    """A sketch as text.  A lone hash above the threshold takes one digit more than the others."""
    if len(sketch) == 1 and sketch[0] >= LIMIT:
        return f"{int(sketch[0]):0{DIGITS + 1}x}"
    return "".join([f"{h:0{DIGITS}x}" for h in sketch.tolist()])


def read(fingerprint: str) -> np.ndarray:
    if len(fingerprint) == DIGITS + 1:
        return np.array([int(fingerprint, 16)], U64)
    return np.array([int(fingerprint[i : i + DIGITS], 16) for i in range(0, len(fingerprint), DIGITS)], U64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts together."""
    out = np.union1d(a, b)
    below = out[out < U64(LIMIT)]
    return below if len(below) else out[:1]


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """The estimated part of a's shingles that b has as well; None if a's sketch is a lone hash above the threshold."""
    if len(a) == 1 and a[0] >= LIMIT and not np.array_equal(a, b):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else float(not len(b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated part of all shingles of both that both have."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, successor: str) -> str:
    """The text with its last quarter replaced by as much of its successor's beginning."""
    n = len(text) // 4
    return text[: len(text) - n] + successor[:n]


def _keys(ids: np.ndarray, hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Triples of signed numbers as strings of 24 bytes in the same order."""
    columns = np.column_stack([np.asarray(c, np.int64).view(U64) ^ U64(1 << 63) for c in (ids, hashes, salts)])
    return columns.astype(">u8").view("S24").ravel()


def by_id_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, part, guest) by ranges of (id, hash), in order, each followed by the next range's first row (``guest``).

    The last range is followed by the first row of all.  Four ranges make a partition, to even out where
    they are hashed to.  The ranges' bounds, 24 bytes each, come to the driver and go to all tasks as one array; they are no part of the plan.  Rows
    that repeat with id and text are cut by a salt, and a task sends one of a range's first rows at most, however often it repeats.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("order_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("h", F.xxhash64("text"))
    rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    key = ("order_id", "h", "salt")
    narrow = rows.select(*key).repartitionByRange(ranges, *key) if ranges > 1 else rows.select(*key).coalesce(1)
    found = narrow.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*key)).alias("m")).select("m.*").orderBy(*key).toArrow()  # a row for each range
    ids, hashes, salts = (found.column(c).to_numpy().copy() for c in key)
    n = len(ids)
    # where a row's copies begin a range, all of them are in it or in the ranges that follow
    fresh = np.append(True, (np.diff(ids) != 0) | (np.diff(hashes) != 0))[:n]
    salts[fresh] = -(1 << 63)
    shared = spark.sparkContext.broadcast((_keys(ids, hashes, salts), _keys(ids, hashes, np.zeros(n, np.int64))))

    def placed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bounds, firsts = shared.value
        sent = np.zeros(len(bounds), bool)
        for i, h, s in batches:
            part = np.maximum(np.searchsorted(bounds, _keys(i, h, s), "right") - 1, 0)
            head = np.flatnonzero((firsts[part] == _keys(i, h, np.zeros(len(i), np.int64))) & ~sent[part])
            head = head[np.unique(part[head], return_index=True)[1]]
            sent[part[head]] = True
            goes = np.full(len(part), -1)
            goes[head] = (part[head] - 1) % len(bounds)
            yield pd.DataFrame({"part": part, "goes_to": goes})

    place = F.pandas_udf(placed, "part int, goes_to int", F.PandasUDFType.SCALAR_ITER).asNondeterministic()
    dealt = rows.withColumn("at", place(*key))
    own, guest = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("guest")), F.struct(F.col("at.goes_to").alias("part"), F.lit(True).alias("guest"))
    dealt = dealt.select("doc_id", "text", "order_id", "h", F.explode(F.when(F.col("at.goes_to") >= 0, F.array(own, guest)).otherwise(F.array(own))).alias("place"))
    dealt = dealt.select("doc_id", "text", "order_id", "h", "place.part", "place.guest")
    return dealt.repartition(max(1, n // 4), "part").sortWithinPartitions("part", "guest", "order_id", "h").select("doc_id", "text", "part", "guest")


def compared(dealt: DataFrame) -> DataFrame:
    """Fingerprints of each row and of its edited text, and its likeness to that and to its successor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows = Hasher(), []
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]
        waiting, seen_guest = None, None  # the row whose successor comes next; the range whose guest has come

        for b in batches:
            for i, text, part, guest in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "part", "guest")), strict=True):
                if guest and part == seen_guest:
                    continue  # further rows of a first id
                codes = code_points(text)
                sketch = hasher.sketch(codes)
                if waiting is not None:
                    j, own, own_codes, own_sketch = waiting
                    new = edited(own, text)
                    new_sketch = hasher.sketch(code_points(new)) if new != own else own_sketch
                    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((j, len(own_codes), digest, spelled(own_sketch), spelled(new_sketch), likeness(own_sketch, new_sketch), likeness(own_sketch, sketch)))
                    if len(rows) >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                waiting = None if guest else (i, text, codes, sketch)
                seen_guest = part if guest else seen_guest
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(run, SCHEMA)


def ranges_for(docs: DataFrame) -> int:
    """Four ranges for each ``RANGE_BYTES`` of text, or for each task of the session if that is more."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts, and likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compared(by_id_ranges(docs, ranges_for(docs)))


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE_SQL: dict[str, str] = {}
