"""Fuzzy C-Means over vector columns.

The loop's state is the centers alone (k rows).  One pass over the data computes the memberships
of the current and of the former centers, their largest difference, the objective, and the
sums for the next centers; sums meet by cluster and dimension, so what comes to the driver
does not grow with the data or the number of tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.vector import argmax, matrix, top_positions

N_CLUSTERS, FUZZINESS = 15, 2.0
MAX_ITER, TOLERANCE, SEED = 150, 1e-4, 42
EPS = float(np.finfo(np.float64).eps)


def exponent_of(m: float, kind: str = "squared") -> float:
    """The power of squared distances: 2 / (m - 1) by default, 1 / (m - 1) in the textbook's form (``standard``)."""
    if m <= 1:
        raise ValueError("m must be above 1")
    return (2.0 if kind == "squared" else 1.0) / (m - 1)


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def memberships_of(x: np.ndarray, centers: np.ndarray, power: float) -> np.ndarray:
    """Rows that sum to 1, computed relative to the nearest center so that nothing overflows."""
    d = np.maximum(squared_distances(x, centers), EPS)
    w = (d.min(axis=1, keepdims=True) / d) ** power
    return w / w.sum(axis=1, keepdims=True)


def with_memberships(rows: DataFrame, centers: np.ndarray, m: float = FUZZINESS, kind: str = "squared", vec_col: str = "vec") -> DataFrame:
    """The rows with ``memberships``."""
    shared, power = rows.sparkSession.sparkContext.broadcast(np.asarray(centers, np.float64)), exponent_of(m, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = memberships_of(matrix(b.column(vec_col)), shared.value, power)
                flat = pa.ListArray.from_arrays(np.arange(0, u.size + 1, u.shape[1], dtype=np.int32), u.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, flat], [*b.schema.names, "memberships"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", memberships array<double>"
    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, m: float, power: float, now: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Numerators and denominators of the next centers, the largest change of a membership, and the objective.

    Without current centers the rows' own ``memberships`` count; without former ones the change is theirs to the current.
    """
    shared = rows.sparkSession.sparkContext.broadcast((now, before))
    cols = ["vec", *(["memberships"] if now is None or before is None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, former = shared.value
        num = den = None
        change = objective = 0.0
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vec"))
            given = matrix(b.column("memberships")) if "memberships" in b.schema.names else None
            u = given if centers is None else memberships_of(x, centers, power)
            if centers is not None:
                old = given if former is None else memberships_of(x, former, power)
                change = max(change, float(np.abs(u - old).max()))
            w = u**m
            if centers is not None:
                objective += float((w * squared_distances(x, centers)).sum())
            num = w.T @ x if num is None else num + w.T @ x
            den = w.sum(axis=0) if den is None else den + w.sum(axis=0)
        if num is not None:
            k, d = num.shape
            cluster = np.concatenate([np.repeat(np.arange(k), d + 1), [-1, -2]])
            dim = np.concatenate([np.tile(np.arange(d + 1), k), [0, 0]])
            value = np.concatenate([np.column_stack([num, den]).ravel(), [change, objective]])
            yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(value)], ["cluster", "dim", "value"])

    got = rows.select(*cols).mapInArrow(run, "cluster int, dim int, value double").groupBy("cluster", "dim").agg(F.sum("value").alias("s"), F.max("value").alias("m")).toArrow()
    c, d, s, top = (got.column(n).to_numpy() for n in ("cluster", "dim", "s", "m"))
    if not len(c):
        raise ValueError("no rows to cluster")
    table = np.zeros((c.max() + 1, d.max() + 1))
    own = c >= 0
    table[c[own], d[own]] = s[own]
    return table[:, :-1], table[:, -1], float(top[c == -1].max(initial=0)), float(s[c == -2].sum())


def hashed_start(id_col: str, k: int, seed: int = SEED) -> Column:
    """Starting memberships from the id alone, whatever the order of rows: normalized exponential draws."""
    def draw(i: Column) -> Column:
        return -F.log((F.pmod(F.xxhash64(F.col(id_col), i, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52))

    drawn = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), draw)
    return F.transform(drawn, lambda x: x / F.aggregate(drawn, F.lit(0.0), lambda a, y: a + y))


def dirichlet_start(n: int, k: int, seed: int = SEED) -> np.ndarray:
    """Starting memberships by row number from numpy's generator, for parity on small data."""
    return np.random.RandomState(seed).dirichlet(np.ones(k), size=n)


@dataclass
class FuzzyCMeans:
    k: int = N_CLUSTERS
    m: float = FUZZINESS
    max_iter: int = MAX_ITER
    tol: float = TOLERANCE
    seed: int = SEED
    kind: str = "squared"
    centers: np.ndarray | None = None
    inertia: float | None = None
    iterations: int = 0
    delta: float | None = None

    def fit(self, rows: DataFrame, id_col: str = "id") -> FuzzyCMeans:
        """Centers of (id, vec) rows; a column ``memberships`` sets the start.  Centers are updated first."""
        if self.max_iter < 1:
            raise ValueError("max_iter must be at least 1")
        power = exponent_of(self.m, self.kind)
        if "memberships" not in rows.columns:
            rows = rows.withColumn("memberships", hashed_start(id_col, self.k, self.seed))
        num, den, _, _ = _sums(rows, self.m, power, None, None)
        before, now = None, num / den[:, None]
        for t in range(1, self.max_iter + 1):
            num, den, self.delta, self.inertia = _sums(rows, self.m, power, now, before)
            self.centers, self.iterations = now, t
            if self.delta < self.tol:
                break
            before, now = now, num / den[:, None]
        return self

    def transform(self, rows: DataFrame, vec_col: str = "vec") -> DataFrame:
        return with_memberships(rows, self.centers, self.m, self.kind, vec_col)

    predict_proba = transform

    def predict(self, rows: DataFrame, vec_col: str = "vec") -> DataFrame:
        return self.transform(rows, vec_col).withColumn("dominant_cluster", argmax(F.col("memberships")))

    def save(self, spark: SparkSession, path: str) -> None:
        """Centers as parquet, parameters as JSON text."""
        frame = [(i, [float(x) for x in c]) for i, c in enumerate(self.centers)]
        spark.createDataFrame(frame, "cluster int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")
        meta = {"k": self.k, "m": self.m, "max_iter": self.max_iter, "tol": self.tol, "seed": self.seed, "kind": self.kind, "inertia": self.inertia, "iterations": self.iterations, "delta": self.delta}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FuzzyCMeans:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        rows = spark.read.parquet(f"{path}/centers").orderBy("cluster").collect()  # k rows
        return FuzzyCMeans(**meta, centers=np.array([r.center for r in rows]))


def assignments(rows: DataFrame, top: int = 3) -> DataFrame:
    """``dominant_cluster`` and the top clusters with memberships of 4 decimals, as stored on documents."""
    best = F.transform(top_positions(F.col("memberships"), top), lambda s: F.struct(s.cluster.alias("cluster"), F.round(s.p, 4).alias("p")))
    return rows.withColumn("dominant_cluster", argmax(F.col("memberships"))).withColumn("cluster_probs", best)


def rendered_probs(probs: Column) -> Column:
    """Cluster probabilities as a JSON object in their order."""
    return F.to_json(F.map_from_entries(F.transform(probs, lambda s: F.struct(s.cluster.cast("string"), s.p))))


def label_centers(rows: DataFrame, label_col: str = "label") -> DataFrame:
    """(cluster, dim, value): mean vectors of labelled rows (vec), summed in each task before they are shuffled."""
    long = rows.select(F.col(label_col).alias("cluster"), F.posexplode("vec").alias("dim", "x"))
    return long.groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def collected_centers(long: DataFrame) -> np.ndarray:
    """The small matrix of (cluster, dim, value) rows."""
    got = long.toArrow()
    c, d, v = (got.column(n).to_numpy() for n in ("cluster", "dim", "value"))
    out = np.zeros((c.max() + 1, d.max() + 1))
    out[c, d] = v
    return out
