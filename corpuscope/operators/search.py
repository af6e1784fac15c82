"""The engine: ingest, cluster, search with the semantic cache, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import snippet, tokens
from corpuscope.operators import cache as semantic
from corpuscope.operators.cache import SemanticCache
from corpuscope.operators.encoder import Encoder, HashingEncoder, embed
from corpuscope.operators.fcm import FUZZINESS, N_CLUSTERS, FuzzyCMeans, assignments
from corpuscope.operators.knn import knn_batch
from corpuscope.operators.pca import CenteredPCA
from corpuscope.shared import written
from corpuscope.sources.corpus import load_corpus
from corpuscope.sources.store import VectorStore

N_RESULTS = 5


def result_rows(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, result): the matches (query_id, item_id, score, rank) as ordered result structs.

    ``docs`` has item_id, doc_id, category, text, dominant_cluster; missing values get their defaults.  A document's snippet is
    made once, however many queries match it, and whole texts are not multiplied by the matches.
    """
    matches = written(matches.select("query_id", "item_id", "score", "rank"), "matches")
    shown = docs.join(matches.select("item_id").distinct(), "item_id", "left_semi").select(
        "item_id", F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("category", F.lit("unknown")).alias("category"), snippet(F.col("text")).alias("text_snippet"),
        F.coalesce("dominant_cluster", F.lit(-1)).cast("int").alias("cluster"),
    )
    joined = matches.join(shown, "item_id")
    one = F.struct("doc_id", "category", "text_snippet", F.round("score", 4).alias("similarity"), "cluster")
    ranked = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("r")))).alias("rows"))  # k rows a query
    return ranked.select("query_id", F.transform("rows", lambda x: x.r).cast(semantic.RESULT).alias("result"))


def answer(queries: DataFrame, entries: DataFrame, vectors: DataFrame, docs: DataFrame, k: int = N_RESULTS, threshold: float = semantic.THRESHOLD, secondary: float = semantic.SECONDARY, found: DataFrame | None = None) -> DataFrame:
    """(query_id, query, cache_hit, entry_idx, matched_query, similarity_score, dominant_cluster, result, score) of a batch.

    A hit carries the entry's result and cluster, whatever k is; only misses are searched.  All
    queries see the same frozen cache.  What a stored cache has ``found`` for the queries need not be looked up again.
    """
    found = written(semantic.lookup(queries, entries, threshold, secondary) if found is None else found, "lookup")
    hits = found.where("hit").join(entries, "entry_idx")
    hit_rows = queries.select("query_id", F.col("query").alias("asked")).join(hits, "query_id").select(
        "query_id", F.col("asked").alias("query"), F.lit(True).alias("cache_hit"), "entry_idx", F.col("query").alias("matched_query"), F.round("score", 4).alias("similarity_score"), "dominant_cluster", "result", "score"
    )
    missed = queries.join(found.where("NOT hit").select("query_id"), "query_id", "left_semi")
    matches = knn_batch(vectors, missed.select("query_id", "vec"), k)
    results = missed.join(result_rows(matches, docs), "query_id", "left")
    miss_rows = results.select(
        "query_id", "query", F.lit(False).alias("cache_hit"), F.lit(None).cast("bigint").alias("entry_idx"), F.lit(None).cast("string").alias("matched_query"),
        F.lit(None).cast("double").alias("similarity_score"), semantic.argmax(F.col("memberships")).alias("dominant_cluster"), F.coalesce("result", F.array().cast(semantic.RESULT)).alias("result"),
        F.lit(None).cast("double").alias("score"),
    )
    return hit_rows.unionByName(miss_rows)


class Engine:
    """Tables below one folder: vectors, model, cache."""

    def __init__(self, spark: SparkSession, path: str, encoder: Encoder | None = None, k: int = N_CLUSTERS, threshold: float = semantic.THRESHOLD) -> None:
        self.spark, self.path, self.encoder, self.k = spark, path.rstrip("/"), encoder or HashingEncoder(), k
        self.store = VectorStore(spark, f"{self.path}/vectors")
        self.cache = SemanticCache(spark, f"{self.path}/cache", k, threshold)
        self.pca: CenteredPCA | None = None
        self.fcm: FuzzyCMeans | None = None

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def ingest(self, articles: DataFrame, mode: str = "errorifexists", min_tokens: int = 50, max_docs_per_category: int | None = None) -> int:
        """Clean, filter, deduplicate, embed and store (category, name, raw_text) articles; rows in the store."""
        docs = embed(load_corpus(articles, min_tokens, max_docs_per_category), self.encoder)
        start = docs.withColumn("dominant_cluster", F.lit(-1)).withColumn("cluster_probs", F.array().cast("array<struct<cluster:int,p:double>>"))
        self.store.add(start, mode)
        return self.store.count()

    def _vectors(self) -> DataFrame:
        return self.store.frame().select(F.col("doc_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))

    def cluster(self, dims: int = 50, m: float = FUZZINESS, **options) -> FuzzyCMeans:  # noqa: ANN003
        """Reduce, fit, save the model and write the assignments back."""
        rows = self._vectors()
        self.pca = CenteredPCA(dims).fit(rows)
        reduced = written(self.pca.transform(rows).select("id", F.col("reduced").alias("vec")), "reduced")
        self.fcm = FuzzyCMeans(k=self.k, m=m, **options).fit(reduced)
        self.pca.save(self.spark, f"{self.path}/model/pca")
        self.fcm.save(self.spark, f"{self.path}/model/fcm")
        found = assignments(self.fcm.transform(reduced)).select(F.col("id").alias("doc_id"), "dominant_cluster", "cluster_probs")
        self.store.update(found)
        return self.fcm

    def load_model(self) -> None:
        self.pca = CenteredPCA.load(self.spark, f"{self.path}/model/pca")
        self.fcm = FuzzyCMeans.load(self.spark, f"{self.path}/model/fcm")

    def with_memberships(self, rows: DataFrame) -> DataFrame:
        """Memberships of vectors (vec); without a model all clusters are equally likely."""
        if not (self.pca and self.fcm):
            return rows.withColumn("memberships", F.array(*[F.lit(1.0 / self.k)] * self.k))
        return self.fcm.transform(self.pca.transform(rows), "reduced").drop("reduced")

    def search(self, queries: DataFrame, k: int = N_RESULTS, batch: int | None = None) -> DataFrame:
        """Answers to (query_id, query) rows; misses are stored.  Blank queries and k below 1 are errors.

        A numbered batch sees the entries of smaller numbers and can run again.
        """
        if k < 1:
            raise ValueError("n_results must be at least 1")
        if not queries.where(F.size(tokens(F.col("query"))) == 0).isEmpty():
            raise ValueError("query must not be blank")
        asked = queries.select("query_id", "query", self.encoder(F.col("query")).alias("vec"))
        asked = written(self.with_memberships(asked), "asked")
        frame = self.store.frame().withColumn("item_id", F.col("doc_id"))
        hits = self.cache.lookup(asked, log=False, batch=batch)
        found = answer(asked, self.cache.entries(batch), frame.select("item_id", F.col("embedding").alias("vec")), frame.drop("embedding"), k, found=hits)
        out = written(found, "answers")
        self.cache.log_hits(out.where("cache_hit").select("query", F.lit(True).alias("hit"), "entry_idx", "score"), batch)
        self.cache.store(asked.join(out.where("NOT cache_hit").select("query_id", "result"), "query_id"), batch)
        return out.drop("score")

    def cache_stats(self) -> dict:
        return self.cache.stats().first().asDict()

    def flush_cache(self) -> dict:
        n = self.cache.flush()
        return {"message": "cache cleared", "entries_cleared": n}

