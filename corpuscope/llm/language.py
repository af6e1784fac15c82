"""Language identification with hyperdimensional profiles (operator 2).

Every letter has a random vector of +1 and -1.  A letter triple is bound into one vector by
multiplying its letters' vectors after permuting (rotating) the first twice and the second once.  A
text's vector bundles (adds) the vectors of its triples, a language's prototype bundles those of its
training texts, and a text gets the language of the prototype with the largest cosine.

Letters' vectors derive from their code points alone, so that executors make them anew and nothing is sent around.
Bundling is linear: a task counts triples first and multiplies the counts with the triples'
vectors.  Prototypes come to the driver as one vector for each language code; there are as many as
codes in the data, checked against ``MAX_LANGUAGES``.

Defined results: texts that are null or have no letter get ``und`` and score 0, as has every text when no
row can be learned from; ties go to the first language in code order; repeated rows are scored
alike; a row with a null language trains nothing, one with a null id counts as not held out.
Texts of any length are read to their end, in pieces; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import U64, code_points, held_out, mix64, slices, table

DIMENSIONS = 1024
SEED = 0x1A2B3C
UNDETERMINED = "und"
#: Code points of text that are worked on at a time.
PIECE = 1 << 18
MAX_LANGUAGES = 4096
#: Triples whose vectors are made at once, and cells of the matrix of counts for each triple of the texts, at most.
TILE, DENSE = 4096, 16
#: A random text's cosine scatters with a deviation of 1 / sqrt(DIMENSIONS); four of them count as evidence.
MIN_SCORE = 4 / DIMENSIONS**0.5


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(8192)
def _letter(code: int) -> np.ndarray:
    """The random vector of a letter; 0 stands for the edge of a word."""
    words = mix64(np.arange(DIMENSIONS // 64, dtype=U64) + U64((code + 1) * 1_000_003 + SEED * 7_919))
    bits = np.unpackbits(words.view(np.uint8))
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def bound(keys: np.ndarray) -> np.ndarray:
    """The bound vectors of packed triples, a row each."""
    codes = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF])
    unique, at = np.unique(codes, return_inverse=True)
    letters = np.stack([_letter(c) for c in unique.tolist()]) if len(unique) else np.zeros((0, DIMENSIONS), np.int8)
    first, second, third = at.reshape(codes.shape)
    return np.roll(letters, 2, axis=1)[first] * np.roll(letters, 1, axis=1)[second] * letters[third]


class TripleVectors:
    """Bound vectors of the letter triples met so far, ``MOST`` of them; forgotten when there are more."""

    MOST = 1 << 15

    def __init__(self) -> None:
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((1024, DIMENSIONS), np.int8)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """A row for each of at most ``MOST`` distinct packed triples."""
        new = [k for k in keys.tolist() if k not in self.row]
        if len(self.row) + len(new) > self.MOST:
            self.row.clear()
            new = keys.tolist()
        while len(self.row) + len(new) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        if new:
            at = len(self.row)
            self.vectors[at : at + len(new)] = bound(np.array(new, np.int64))
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return self.vectors[[self.row[k] for k in keys.tolist()]]


def triples(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, packed letter triple) of all texts, about ``PIECE`` at a time.

    A triple is a letter between its neighbours, where everything that is no letter counts as the same
    edge; so each letter of a text is the middle of one triple, and no triple spans two words.
    """
    parts: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        codes, own = np.concatenate(parts), np.concatenate(owners)
        keep = np.flatnonzero((codes != 0) & (own >= 0))
        return own[keep], codes[keep - 1] << 42 | codes[keep] << 21 | codes[keep + 1]

    for n, text in enumerate(texts):
        lower = text.lower()
        for at in range(0, len(lower), PIECE):
            got = code_points(lower[max(0, at - 1) : at + PIECE + 1])
            codes = np.zeros(len(got) + 2, np.int64)
            codes[1:-1] = np.where(_is_letter()[got], got, 0)
            own = np.full(len(codes), n, np.int64)
            own[: 2 if at else 1] = -1  # context only
            own[-2 if at + PIECE < len(lower) else -1 :] = -1
            parts.append(codes)
            owners.append(own)
            held += len(codes)
            if held >= PIECE:
                yield flush()
                parts, owners, held = [], [], 0
    if held:
        yield flush()


def bundled(texts: list[str], rows: np.ndarray, n_rows: int, known: TripleVectors) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the triples' vectors of all texts that belong to each row, and their number.

    Triples that repeat are counted and the counts multiplied with their vectors.  Where most occur once, as in scripts of
    many letters, vectors are added up in the order of the rows, a tile of ``TILE`` triples at a time.  So neither counts nor vectors
    take more than some megabytes.
    """
    out, letters = np.zeros((n_rows, DIMENSIONS)), np.zeros(n_rows, np.int64)
    for own, keys in triples(texts):
        if not len(keys):
            continue
        row = rows[own]
        letters += np.bincount(row, minlength=n_rows)
        order = np.argsort(row, kind="stable")
        row, keys = row[order], keys[order]
        here, of = np.unique(row, return_inverse=True)
        unique, at = np.unique(keys, return_inverse=True)
        if len(here) * len(unique) <= DENSE * len(keys):
            counts = np.bincount(of * len(unique) + at, minlength=len(here) * len(unique)).reshape(len(here), -1).astype(np.float32)
            for x in range(0, len(unique), TILE):
                out[here] += counts[:, x : x + TILE] @ known.of(unique[x : x + TILE]).astype(np.float32)
            continue
        for x in range(0, len(keys), TILE):
            part, where = np.unique(keys[x : x + TILE], return_inverse=True)
            first = np.flatnonzero(np.diff(row[x : x + TILE], prepend=-1))
            out[row[x : x + TILE][first]] += np.add.reduceat(bound(part)[where], first, axis=0, dtype=np.int32)
    return out, letters


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A unit vector for each language of the training rows (text, lang): all of them count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        known = TripleVectors()
        for b in slices(batches):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            names = sorted(set(langs))
            row = {x: k for k, x in enumerate(names)}
            sums, _ = bundled(texts, np.array([row[x] for x in langs], np.int64), len(names), known)
            for x, v in zip(names, sums, strict=True):
                total[x] = total.get(x, 0) + v
        for x, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [x] * DIMENSIONS, "dim": np.arange(DIMENSIONS, dtype=np.int32), "value": v})

    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    sums = learn.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    got = sums.limit(MAX_LANGUAGES * DIMENSIONS + 1).toArrow()
    if got.num_rows > MAX_LANGUAGES * DIMENSIONS:
        raise ValueError(f"more than {MAX_LANGUAGES} language codes")
    names, which = np.unique(np.array(got.column("lang").to_pylist(), object), return_inverse=True)
    sums_of = np.zeros((len(names), DIMENSIONS))
    sums_of[which, got.column("dim").to_numpy()] = got.column("value").to_numpy()
    out = dict(zip(names.tolist(), sums_of, strict=True))
    return {x: v / n for x, v in sorted(out.items()) if (n := float(np.sqrt(v @ v)))}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep) of every row with ``lang_pred``, ``score`` and the number of ``letters`` that they rest on.

    These three replace kept columns of the same names.
    """
    spark = docs.sparkSession
    out = [c for c in dict.fromkeys((id_col, *keep)) if c not in ("lang_pred", "score", "letters")]
    names = list(learned)
    shared = spark.sparkContext.broadcast(np.stack(list(learned.values())) if names else np.zeros((0, DIMENSIONS)))  # MAX_LANGUAGES rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profile, known = shared.value, TripleVectors()
        for b in slices(batches):  # a vector for each row
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            vectors, letters = bundled(texts, np.arange(len(texts)), len(texts), known)
            norm = np.sqrt((vectors * vectors).sum(axis=1))
            seen = np.array([bool(v) for v in norm]) if names else np.zeros(len(texts), bool)
            cosine = vectors @ profile.T / np.where(norm, norm, 1)[:, None] if names else np.zeros((len(texts), 1))
            best = cosine.argmax(axis=1) if len(texts) else np.zeros(0, int)
            score = np.where(seen, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
            lang = [names[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), seen.tolist(), strict=True)]
            kept = [b.column(c) for c in out]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(letters)], [*out, "lang_pred", "score", "letters"])

    narrow = docs.select(*dict.fromkeys((*out, text_col)))
    schema = narrow.select(*out).schema.add("lang_pred", "string").add("score", "double").add("letters", "long")
    return narrow.mapInArrow(run, schema)


def rejected(min_letters: int = 32, min_score: float = MIN_SCORE) -> Column:
    """Rows whose text is in no known language: no letters, or many letters that resemble nothing learned.

    A few letters are too little evidence to reject a text.
    """
    return (F.col("lang_pred") == UNDETERMINED) | ((F.col("letters") >= min_letters) & (F.col("score") < min_score))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from the rows of documents that are not held out."""
    return prototypes(docs.where(~held_out(F.col("doc_id"))))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "letters")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL: dict[str, str] = {}
