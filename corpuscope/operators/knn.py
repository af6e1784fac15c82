"""Nearest neighbours by cosine of unit vectors: one query, many queries, with a metadata filter.

Many queries are worked off in blocks of ``BLOCK_BYTES``, one after another.  A block is broadcast, every task scores its rows
against it tile by tile, ``TILE`` scores at a time, and keeps the best ``k`` of each query, and only those meet in a
window.  So no pair of query and row is ever a row of a frame, the driver holds one block at a time, and a task a block, its best and a tile.

Rows and queries can have flags, of which a pair must share one; a task then multiplies flag by flag where that is less work than
all at once.  Rows can also lie in stored lists, of which a query reads its own (``ListStore``, ``IvfIndex``).

Ids can be numbers or strings; ties go to the smaller id.  Null vectors, and vectors of another length than the longest
query, match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.functions.vector import dot, matrix
from corpuscope.shared import new_path, written

DEFAULT_K = 10
BLOCK_BYTES = 48 << 20
#: Rows that are scored together, and scores that a task holds at once.
ROWS_AT_ONCE, TILE = 1024, 1 << 20
#: Rows in a file of a stored list, and the tasks that a list is written by.
LIST_ROWS, LIST_SPREAD = 1 << 17, 4
_COMPARE = {"$eq": "__eq__", "$ne": "__ne__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}


def predicate(where: dict[str, Any]) -> Column:
    """A metadata filter such as ``{"$and": [{"category": "a"}, {"n": {"$gte": 3}}]}`` as a condition."""
    out: list[Column] = []
    for name, value in where.items():
        if name in ("$and", "$or"):
            parts = [predicate(w) for w in value]
            if not parts:
                raise ValueError(f"{name} needs conditions")
            out.append(reduce(lambda a, b: a & b if name == "$and" else a | b, parts))  # noqa: B023
        elif isinstance(value, dict):
            for op, x in value.items():
                if op in ("$in", "$nin"):
                    found = F.col(name).isin(list(x))
                    out.append(found if op == "$in" else ~found)
                elif op in _COMPARE:
                    out.append(getattr(F.col(name), _COMPARE[op])(x))
                else:
                    raise ValueError(f"unknown operator {op}")
        else:
            out.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, out) if out else F.lit(True)


def knn_single(rows: DataFrame, query: list[float], k: int = DEFAULT_K, id_col: str = "vec_id", vec_col: str = "embedding", where: dict | None = None) -> DataFrame:
    """The k rows with the largest cosine, smaller ids first on ties, with ``similarity``.

    The filter reaches the scan, and Spark keeps k rows for each task.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows = rows.where(predicate(where)) if where else rows
    score = dot(F.col(vec_col), F.array(*[F.lit(float(x)) for x in query]))
    return rows.withColumn("similarity", score).orderBy(F.desc("similarity"), id_col).limit(k)


class Best:
    """The k best items of each of some queries, by score and then by smaller id, fed tile by tile."""

    def __init__(self, n: int, k: int, least: float | None = None, twins: bool = False) -> None:
        self.k, self.twins = k, twins  # with ``twins`` an item can come several times, and counts once
        self.score, self.ref = np.full((n, k), -np.inf), np.full((n, k), -1)
        self.floor = np.full(n, -np.inf if least is None else least)
        self.items: np.ndarray | None = None  # what ``ref`` points to

    def add(self, items: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        """Take up the scores of the queries ``at`` (rows) with some items (columns); minus infinity is no pair."""
        hit = (score >= self.floor[at, None]) & (score > -np.inf)
        if score.shape[1] > self.k and int(hit.sum()) > 2 * self.k * len(at):
            rest = score.shape[1] - self.k
            hit &= score >= np.partition(score, rest, axis=1)[:, rest, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        used, place = np.unique(j, return_inverse=True)
        base = 0 if self.items is None else len(self.items)
        self.items = items[used] if self.items is None else np.concatenate([self.items, items[used]])
        rows, query = np.unique(i, return_inverse=True)
        q = at[rows]
        oi, oj = np.nonzero(self.ref[q] >= 0)
        query, new = np.concatenate([query, oi]), np.concatenate([score[i, j], self.score[q][oi, oj]])
        ref = np.concatenate([base + place, self.ref[q][oi, oj]])
        if self.twins:
            item = self.items[ref]
            order = np.lexsort((-new, item, query))
            other = (np.diff(query[order], prepend=-1) != 0) | np.append(True, item[order][1:] != item[order][:-1])
            query, new, ref = (x[order][other] for x in (query, new, ref))
        order = np.lexsort((self.items[ref], -new, query))
        query, new, ref = query[order], new[order], ref[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.score[q], self.ref[q] = -np.inf, -1
        self.score[q[query[kept]], rank[kept]], self.ref[q[query[kept]], rank[kept]] = new[kept], ref[kept]
        self.floor[q] = np.maximum(self.floor[q], self.score[q, -1])
        if len(self.items) > 2 * self.ref.size + ROWS_AT_ONCE:  # forget items that are no one's best any more
            live = self.ref >= 0
            used, place = np.unique(self.ref[live], return_inverse=True)
            self.items, self.ref[live] = self.items[used], place

    def batch(self, ids: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, item_id, score), if there are any."""
        i, j = np.nonzero(self.ref >= 0)
        if len(i):
            found = pa.array(self.items[self.ref[i, j]], kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), found, pa.array(self.score[i, j])], ["query_id", "item_id", "score"])


def _items(column: pa.Array) -> np.ndarray:
    """Ids as numbers or as strings, which sort."""
    out = column.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def _in_blocks(queries: DataFrame, rows: DataFrame, k: int, extra: list[str], width: int, block: int | None, scored: Callable) -> DataFrame:
    """The k best of each query, block after block; ``scored`` (block, ids, vectors, dimensions, schema) gives a block's frame."""
    spark = queries.sparkSession
    queries = written(queries.select("query_id", "vec", *extra).where("vec IS NOT NULL").withColumn("part", F.xxhash64("query_id")), "queries")
    n, d = queries.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    kinds = {c: f.simpleString() for c, f in ((f.name, f.dataType) for f in (*queries.schema, *rows.schema)) if c in ("query_id", "item_id")}
    schema = f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double"
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    block = block or max(1, BLOCK_BYTES // (8 * max(1, d) + 16 * k + width))
    n_blocks = -(-2 * n // block) if n > block else 1
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    path = new_path(spark, "nearest")
    for b in range(n_blocks):
        got = queries.where((F.pmod("part", F.lit(n_blocks)) == b) & (F.size("vec") == d)).toArrow()  # BLOCK_BYTES, or about ``block`` rows
        ids = got.column("query_id").to_numpy(zero_copy_only=False)
        best = scored(got, ids, matrix(got.column("vec"), d), d, schema).withColumn("rank", rank).where(F.col("rank") <= k)
        if n_blocks == 1:
            return best
        best.write.mode("append").parquet(path)
    return spark.read.schema(best.schema).parquet(path)


def block_top(queries: DataFrame, rows: DataFrame, k: int, least: float | None = None, masked: bool = False, block: int | None = None, earlier: bool = False) -> DataFrame:
    """(query_id, item_id, score, rank) of the k best rows for each query.

    ``queries`` has query_id and vec, ``rows`` has item_id and vec; with ``masked`` both also have
    ``mask``, an array of flags, and only rows that share a flag with the query count.  Scores below
    ``least`` do not count; with ``earlier`` only rows with smaller ids than the query's do.  A block has ``block`` queries, or as many as make ``BLOCK_BYTES`` with their best.
    """
    flags = (queries.agg(F.max(F.size("mask"))).first()[0] or 0) if masked else 0

    def scored(got: pa.Table, ids: np.ndarray, q: np.ndarray, d: int, schema: str) -> DataFrame:
        wants = matrix(got.column("mask"), flags, np.float32) if masked else None
        shared = rows.sparkSession.sparkContext.broadcast((ids, q, wants))
        fit = rows.where(F.size("vec") == d)
        if masked:
            fit = fit.where(F.size("mask") == flags)
        return _block_top(fit, shared, k, least, schema, earlier)

    return _in_blocks(queries.where(F.size("mask") == flags) if masked else queries, rows, k, ["mask"] if masked else [], 4 * flags, block, scored)


def _scores(e: np.ndarray, q: np.ndarray, has: np.ndarray | None, wants: np.ndarray | None) -> np.ndarray:
    """Scores of rows by queries, minus infinity where they share no flag.

    Flag by flag only the rows and queries that have it are multiplied, unless that is more than all of them.
    """
    if has is None:
        return e @ q.T
    if int(has.sum(axis=0) @ wants.sum(axis=0)) >= len(e) * len(q):
        return np.where(has @ wants.T > 0, e @ q.T, -np.inf)
    out = np.full((len(e), len(q)), -np.inf)
    for c in range(has.shape[1]):
        i, j = np.flatnonzero(has[:, c]), np.flatnonzero(wants[:, c])
        if len(i) and len(j):
            out[np.ix_(i, j)] = e[i] @ q[j].T
    return out


def tiles(items: np.ndarray, e: np.ndarray, q: np.ndarray, at: np.ndarray, has: np.ndarray | None = None, wants: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Scores of the queries ``at`` (rows) with items, ``TILE`` at a time: (items, queries, scores)."""
    for lo in range(0, len(items), ROWS_AT_ONCE):
        rows = slice(lo, lo + ROWS_AT_ONCE)
        step = max(1, TILE // len(items[rows]))
        for q_lo in range(0, len(at), step):
            some = at[q_lo : q_lo + step]
            yield rows, some, _scores(q[some], e[rows], None if wants is None else wants[some], None if has is None else has[rows])


def feed(best: Best, items: np.ndarray, e: np.ndarray, q: np.ndarray, at: np.ndarray, has: np.ndarray | None = None, wants: np.ndarray | None = None, ids: np.ndarray | None = None) -> None:
    """Score items against the queries ``at`` and keep the best; with the queries' ``ids`` only items with smaller ones."""
    for rows, some, score in tiles(items, e, q, at, has, wants):
        best.add(items[rows], score if ids is None else np.where(items[rows] < ids[some, None], score, -np.inf), some)


def _block_top(rows: DataFrame, shared: Any, k: int, least: float | None, schema: str, earlier: bool = False) -> DataFrame:
    masked = shared.value[2] is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, wants = shared.value
        best, every, kind = Best(len(ids), k, least), np.arange(len(ids)), None
        for b in batches:
            kind = b.column("item_id").type
            has = matrix(b.column("mask"), wants.shape[1], np.float32) if wants is not None else None
            feed(best, _items(b.column("item_id")), matrix(b.column("vec"), q.shape[1]), q, every, has, wants, ids if earlier else None)
        yield from best.batch(ids, kind)

    return rows.select("item_id", "vec", *(["mask"] if masked else [])).mapInArrow(run, schema)


class ListStore:
    """Vectors in a folder for each list, of which a query reads those it names and no others.

    A row may be in several lists.  Rows of a list are spread over files of ``LIST_ROWS``, so a list that has a third of all rows is many
    files and many tasks.  Every write is a version of its own; a reader sees versions that are whole.
    """

    def __init__(self, spark: SparkSession, path: str, item: str = "long") -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"item_id {item}, vec array<double>, version bigint, list int"

    def write(self, rows: DataFrame, version: int = 0) -> None:
        """Add rows (list, item_id, vec); a version that is written again replaces what it held."""
        spread = F.pmod(F.xxhash64("item_id"), F.lit(LIST_SPREAD))
        placed = rows.select("item_id", F.col("vec").cast("array<double>").alias("vec"), "list").repartition(F.col("list"), spread)
        placed.write.mode("overwrite").partitionBy("list").option("maxRecordsPerFile", LIST_ROWS).parquet(f"{self.path}/version={version}")

    def read(self, lists: list[int] | None = None, before: int | None = None) -> DataFrame:
        """(item_id, vec, list) of some lists; only their folders are listed as files to read."""
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        rows = self.spark.read.schema(self.schema).parquet(self.path) if there else self.spark.createDataFrame([], self.schema)
        if before is not None:
            rows = rows.where(F.col("version") < before)
        return (rows if lists is None else rows.where(F.col("list").isin(lists))).select("item_id", "vec", "list")

    def search(self, queries: DataFrame, k: int, least: float | None = None, block: int | None = None, before: int | None = None) -> DataFrame:
        """As ``block_top``, of queries (query_id, vec, lists) among the rows of their lists.

        A row that lies in several of a query's lists counts once.
        """
        if k < 1:
            raise ValueError("k must be at least 1")
        width = 8 * (queries.agg(F.max(F.size("lists"))).first()[0] or 0)

        def scored(got: pa.Table, ids: np.ndarray, q: np.ndarray, d: int, schema: str) -> DataFrame:
            asked = got.column("lists").combine_chunks()
            of = pa.compute.list_parent_indices(asked).to_numpy(zero_copy_only=False)
            lists = pa.compute.list_flatten(asked).to_numpy(zero_copy_only=False)
            order = np.argsort(lists, kind="stable")
            names, first = np.unique(lists[order], return_index=True)
            asking = dict(zip(names.tolist(), np.split(of[order], first[1:]), strict=True)) if len(names) else {}
            shared = self.spark.sparkContext.broadcast((ids, q, asking))
            fit = self.read(sorted(asking), before).where(F.size("vec") == d)
            return _list_top(fit, shared, k, least, schema)

        return _in_blocks(queries, self.read([]), k, ["lists"], width, block, scored)


def _list_top(rows: DataFrame, shared: Any, k: int, least: float | None, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, asking = shared.value
        best, kind = Best(len(ids), k, least, twins=True), None
        for b in batches:
            kind = b.column("item_id").type
            items, e, lists = _items(b.column("item_id")), matrix(b.column("vec"), q.shape[1]), b.column("list").to_numpy(zero_copy_only=False)
            for name in np.unique(lists).tolist():
                here = lists == name
                feed(best, items[here], e[here], q, asking[name])
        yield from best.batch(ids, kind)

    found = rows.select("item_id", "vec", "list").mapInArrow(run, schema)
    return found.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))  # from several lists


@dataclass
class IvfIndex:
    """An inverted file: every row belongs to the nearest of some centers, and a query looks at its nearest few.

    Centers are fitted on at most ``sample`` rows, the ones with the smallest hashes of their ids; every row is indexed.  ``store`` writes the
    lists, and ``search`` reads the lists that its queries probe and scores their rows exactly.
    ``recall`` measures what a number of ``probes`` finds against the exact search.
    """

    n_lists: int = 64
    sample: int = 50_000
    rounds: int = 8
    centers: np.ndarray | None = None

    def fit(self, rows: DataFrame, id_col: str = "item_id") -> IvfIndex:
        few = rows.where("vec IS NOT NULL").select(id_col, "vec").orderBy(F.xxhash64(id_col), id_col).limit(self.sample).toArrow()  # ``sample`` rows
        width = max((len(v) for v in few.column("vec")), default=0)
        x = matrix(few.column("vec"), width) if width else np.zeros((0, 0))
        c = x[: self.n_lists].copy()
        for _ in range(self.rounds):
            at = (x @ c.T).argmax(axis=1) if len(c) else np.zeros(0, int)
            for k in range(len(c)):
                if (at == k).any():
                    v = x[at == k].sum(axis=0)
                    c[k] = v / max(1e-12, float(np.sqrt(v @ v)))
        self.centers = c
        return self

    def listed(self, rows: DataFrame, probes: int = 1) -> DataFrame:
        """The rows with ``lists``: the numbers of the nearest centers; none for vectors of another length."""
        shared = rows.sparkSession.sparkContext.broadcast(self.centers)  # n_lists rows

        @F.pandas_udf("array<int>")
        def nearest(vecs: pd.Series) -> pd.Series:
            c = shared.value
            out = [np.zeros(0, np.int32)] * len(vecs)
            fit = [i for i, v in enumerate(vecs) if v is not None and c.size and len(v) == c.shape[1]]
            if fit:
                score = np.stack([vecs.iloc[i] for i in fit]).astype(np.float64) @ c.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
                for i, t in zip(fit, top, strict=True):
                    out[i] = t
            return pd.Series(out, dtype=object)

        return rows.withColumn("lists", nearest("vec"))

    def store(self, rows: DataFrame, path: str) -> ListStore:
        """Write (item_id, vec) by list; rows without a list are in none, as no query of the centers' length matches them."""
        stored = ListStore(rows.sparkSession, path, rows.schema["item_id"].dataType.simpleString())
        stored.write(self.listed(rows).where(F.size("lists") > 0).withColumn("list", F.col("lists")[0]))
        return stored

    def search(self, stored: ListStore, queries: DataFrame, k: int = DEFAULT_K, probes: int = 8) -> DataFrame:
        """As ``knn_batch``, among the rows of each query's nearest lists."""
        return stored.search(self.listed(queries, probes), k)

    def recall(self, rows: DataFrame, stored: ListStore, queries: DataFrame, k: int = DEFAULT_K, probes: int = 8) -> float:
        exact = written(knn_batch(rows, queries, k).select("query_id", "item_id"), "exact")
        found = exact.join(self.search(stored, queries, k, probes).select("query_id", "item_id"), ["query_id", "item_id"]).count()
        return found / max(1, exact.count())


def knn_batch(rows: DataFrame, queries: DataFrame, k: int = DEFAULT_K, where: dict | None = None) -> DataFrame:
    """(query_id, item_id, score, rank): ``rows`` and ``queries`` are (id, vec) as in ``block_top``."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return block_top(queries, rows.where(predicate(where)) if where else rows, k)


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of ids, by two equi-joins with (id, vec)."""
    one = vectors.select(F.col("id").alias("a"), F.col("vec").alias("vec_a"))
    two = vectors.select(F.col("id").alias("b"), F.col("vec").alias("vec_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", dot(F.col("vec_a"), F.col("vec_b")).alias("similarity"))


def threshold_sweep(similarities: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_pairs, hits, hit_pct): one aggregation with a column for each threshold."""
    sums = [F.sum((F.col("similarity") >= t).cast("long")).alias(f"h{k}") for k, t in enumerate(thresholds)]
    got = similarities.agg(F.count(F.lit(1)).alias("n_pairs"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"h{k}").alias("hits")) for k, t in enumerate(thresholds)]))
    rows = got.select("n_pairs", each.alias("x")).select("x.threshold", "n_pairs", F.coalesce("x.hits", F.lit(0)).alias("hits"))
    return rows.withColumn("hit_pct", F.when(F.col("n_pairs") > 0, F.round(100 * F.col("hits") / F.col("n_pairs"), 0)).otherwise(0.0))
