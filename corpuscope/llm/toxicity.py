"""Toxicity by a character n-gram classifier on naive Bayes features (operator 5).

A text's features are the character n-grams of its words, hashed to a fixed number of buckets and
counted as present or absent.  Each feature is scaled by its naive Bayes log-count ratio, the log of how much
likelier it is in label 1 than in label 0, and a logistic regression is fitted on the scaled features.

The ratios count every labelled training row.  Counts are summed in each task
first, so that what comes together has one row for each bucket and task, and the sums (at most
``BUCKETS`` rows) come to the driver.  Features whose ratio is small (``MIN_RATIO``) or not told from chance (``MIN_ERRORS``) have
weight 0, a selection that is part of the model.  The regression is fitted on the driver on a bounded sample of distinct labelled
texts, the ones with the smallest hashes: at most ``SAMPLE`` texts with at most ``SAMPLE_FEATURES`` features together.
The weights (``BUCKETS`` floats) are broadcast.

Defined results: null and empty texts have no features and get the score that the intercept gives; without
training rows of both labels every score is the share of label 1 (0 without any); repeated rows
score alike; a document with several labels counts as toxic if one of them says so; null labels
train nothing; texts of any length are read to their end, in pieces; an empty table gives an empty result; columns that are
not asked for are neither read nor kept, and ``score`` replaces a kept column of its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import U64, chunks, code_points, held_out, mix64, slices, table

BUCKET_BITS = 20
BUCKETS = 1 << BUCKET_BITS
SIZES = (3, 4, 5)
#: Labelled texts that the regression is fitted on, and their features, at most.
SAMPLE, SAMPLE_FEATURES = 32_768, 16_000_000
#: Features of a smaller absolute log-count ratio tell the labels too little apart and are left out.
MIN_RATIO = 0.7
#: Nor are ratios within so many standard errors of 0 told from chance.
MIN_ERRORS = 3.0
SMOOTHING = 1.0
L2 = 0.002
ROUNDS = 300
THRESHOLD = 0.3
PIECE = 1 << 19
CACHE_ENTRIES, CACHE_BYTES = 100_000, 24 << 20
WORD = re.compile(r"[^\W\d_]+")
MULTIPLIER = U64(0x9E3779B97F4A7C15)


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every character n-gram of the words, whose edges count as a character."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    codes = np.zeros(int(ends[-1]) if len(words) else 0, U64)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = inner[np.concatenate([[0], ends[:-1]])[: len(ends)]] = False
    codes[inner] = code_points("".join(words))
    own = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    hashed, whole, found = codes, np.ones(len(codes), bool), []
    for n in range(2, max(SIZES) + 1):
        if len(codes) < n:
            break
        # all characters but the first and the last lie inside a word
        whole = whole[:-1] & inner[n - 2 : len(codes) - 1] if n > 2 else whole[:-1]
        hashed = hashed[:-1] * MULTIPLIER + codes[n - 1 :]
        if n in SIZES:
            at = np.flatnonzero(whole)
            found.append((own[at], (mix64(hashed[at] + U64(n)) >> U64(64 - BUCKET_BITS)).astype(np.uint32)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def words_of(text: str) -> set[str]:
    """The distinct lower-case words of a whole text, read in pieces that end where a word does."""
    lower, at, out = text.lower(), 0, set()
    while at < len(lower):
        end = at + PIECE
        while end < len(lower) and lower[end].isalpha():
            end += 1
        out.update(WORD.findall(lower, at, end))
        at = end
    return out


class WordFeatures:
    """Buckets of words as 32-bit bytes, with a bounded cache; only of wanted buckets if given."""

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        self.wanted = wanted
        self.known: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        own, bucket = ngrams(words)
        if self.wanted is not None:
            keep = self.wanted[bucket]
            own, bucket = own[keep], bucket[keep]
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(len(words) + 1)).tolist()
        body = bucket[order].tobytes()
        for k, w in enumerate(words):
            self.known[w] = body[4 * cuts[k] : 4 * cuts[k + 1]]
            self.held += len(w) + len(self.known[w])

    def of(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct (text number, bucket) pairs, sorted, of ranges of the texts."""
        for a, b in chunks(texts, PIECE):
            sets = [words_of(t) for t in texts[a:b]]
            new = set().union(*sets) - self.known.keys()
            if len(self.known) + len(new) > CACHE_ENTRIES or self.held > CACHE_BYTES:
                self.known, self.held = {}, 0
                new = set().union(*sets)
            if new:
                self.learn(list(new))
            bodies = [b"".join(map(self.known.__getitem__, s)) for s in sets]
            own = np.repeat(np.arange(a, b), [len(x) // 4 for x in bodies])
            pairs = np.unique(own << BUCKET_BITS | np.frombuffer(b"".join(bodies), np.uint32))
            yield pairs >> BUCKET_BITS, pairs & (BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    """Weights of the buckets, times their log-count ratios, and the intercept."""

    weight: np.ndarray
    intercept: float

    def scores(self, texts: list[str], known: WordFeatures) -> np.ndarray:
        z = np.full(len(texts), self.intercept)
        for own, bucket in known.of(texts):
            z += np.bincount(own, self.weight[bucket], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def log_count_ratios(rows_with: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Naive Bayes ratios from (label, bucket) counts of rows; 0 where they say too little."""
    p = (rows_with + SMOOTHING) / (totals[:, None] + 2 * SMOOTHING)
    r = np.log(p[1] / p[0])
    error = np.sqrt((1 / (rows_with + SMOOTHING)).sum(axis=0))
    return np.where((np.abs(r) >= MIN_RATIO) & (np.abs(r) >= MIN_ERRORS * error), r, 0.0)


def fitted(own: np.ndarray, bucket: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression with an L2 penalty by accelerated gradient steps."""
    used, at = np.unique(bucket, return_inverse=True)
    x = ratio[used][at]
    n, d = len(y), len(used)

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(own, x * w[at], minlength=n)

    def back(g: np.ndarray) -> np.ndarray:
        return np.bincount(at, x * g[own], minlength=d)

    v = np.ones(d) / max(1, d) ** 0.5
    top = 1.0
    for _ in range(12):  # the largest curvature, for the step
        v = back(forward(v))
        top = float(np.sqrt(v @ v)) or 1.0
        v = v / top
    step = 1 / (0.3 * top / n + L2 + 0.25)
    prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    w, b = np.zeros(d), float(np.log(prior / (1 - prior)))
    w_, b_, t = w, b, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(b_ + forward(w_), -30, 30)))
        g = (p - y) / n
        w2, b2 = w_ - step * (back(g) + L2 * w_), b_ - step * float(g.sum())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w_, b_ = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    weight = np.zeros(BUCKETS)
    weight[used] = w * ratio[used]
    return Model(weight, b)


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each label with each bucket, and rows of each label, of a frame (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, known = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64), WordFeatures()
        for b in slices(batches):
            texts, label = [x or "" for x in b.column("text").to_pylist()], np.array(b.column("label").to_pylist(), np.int64)
            total += np.bincount(label, minlength=2)
            for own, bucket in known.of(texts):
                count += np.bincount(label[own] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, -1)
        at = np.flatnonzero(count.sum(axis=0))
        if total.any():
            yield pa.RecordBatch.from_pydict({"bucket": np.append(at, BUCKETS).astype(np.int32), "n0": np.append(count[0, at], total[0]), "n1": np.append(count[1, at], total[1])})

    got = rows.mapInArrow(run, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, BUCKETS + 1), np.int64)
    at = got.column("bucket").to_numpy()
    out[0, at], out[1, at] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    return out[:, :-1], out[:, -1]


def sampled(docs: DataFrame, truth: DataFrame, wanted: np.ndarray, sample: int, most_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of the distinct texts (doc_id, text) with a label: row numbers, buckets, labels.

    Hashes and sizes are made before the join, so that only the sample's texts are shuffled.
    """
    spark = docs.sparkSession
    # a text has at most one n-gram of each size for each of its characters and edges
    size = F.least(F.length(F.coalesce("text", F.lit(""))) * 2 * len(SIZES), F.lit(int(wanted.sum()))).cast("long")
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"), size.alias("size")).join(truth.hint("merge"), "doc_id")
    few = rows.groupBy("h").agg(F.min("size").alias("size")).orderBy("h").limit(sample + 1).toArrow()  # two numbers for each text of the sample
    upto = np.cumsum(few.column("size").to_numpy())
    n = min(sample, int(np.searchsorted(upto, most_features, side="right")))
    cut = int(few.column("h")[n].as_py()) if n < few.num_rows else 1 << 62
    chosen = rows.where(F.col("h") < cut) if n < few.num_rows else rows
    shared = spark.sparkContext.broadcast(np.packbits(wanted))  # BUCKETS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures(np.unpackbits(shared.value).astype(bool))
        for b in slices(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            lists: list[list[int]] = [[] for _ in texts]
            for own, bucket in known.of(texts):
                cuts = np.searchsorted(own, np.arange(own[0], own[-1] + 2)) if len(own) else []
                for k in range(len(cuts) - 1):
                    lists[int(own[0]) + k] = bucket[cuts[k] : cuts[k + 1]].tolist()
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label"), pa.array(lists, pa.list_(pa.int32()))], ["h", "label", "buckets"])

    made = chosen.select("h", "text", "label").mapInArrow(run, "h long, label int, buckets array<int>")
    got = made.groupBy("h").agg(F.max("label").alias("label"), F.first("buckets").alias("buckets")).toArrow().sort_by("h")
    y = got.column("label").to_numpy()
    lists = got.column("buckets").combine_chunks()
    own = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy()) if len(y) else np.zeros(0, np.int64)
    return own, lists.flatten().to_numpy(), y


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic), without the held-out rows."""
    truth = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    truth = truth.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    # labels grow with the documents: they are never broadcast, so the plan is the same at every size
    docs = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")))
    count, total = counted(docs.join(truth.hint("merge"), "doc_id").select("text", "label"))
    if not total.all():
        share = float(total[1] / total.sum()) if total.sum() else 0.0
        return Model(np.zeros(BUCKETS), float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))))
    ratio = log_count_ratios(count, total)
    own, bucket, y = sampled(docs, truth, ratio != 0, sample, most_features)
    return fitted(own, bucket, y, ratio)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep) of every row with ``score``, the probability of label 1."""
    out = [c for c in dict.fromkeys((id_col, *keep)) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.intercept))  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, intercept = shared.value
        here = Model(weight.astype(np.float64), intercept)
        known = WordFeatures(here.weight != 0)
        for b in slices(batches):
            got = here.scores([x or "" for x in b.column(text_col).to_pylist()], known)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(got, pa.float64())], [*out, "score"])

    narrow = docs.select(*dict.fromkeys((*out, text_col)))
    return narrow.mapInArrow(run, narrow.select(*out).schema.add("score", "double"))


def predicted(score_col: str | Column = "score", threshold: float = THRESHOLD) -> Column:
    return (F.col(score_col) if isinstance(score_col, str) else score_col).__ge__(threshold).cast("int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted().alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
