"""Every query of the engine's own operators, with DuckDB SQL for those that SQL can express.

Each runs over its whole tables.  ``documents.source`` stands for the category, ``embeddings`` for
vectors, even vector ids for cache entries and odd ones for queries.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import text as T
from corpuscope.functions import vector as V
from corpuscope.operators import cache, fcm, knn, quality, search, stages, terms
from corpuscope.operators.latent import LatentEncoder
from corpuscope.operators.pca import CenteredPCA
from corpuscope.plans import fixtures
from corpuscope.plans.fixtures import NOISY_ARTICLE, RAW_ARTICLE
from corpuscope.shared import new_path, written
from corpuscope.sources import corpus
from corpuscope.sources.files import read_files
from corpuscope.sources.seen import SeenTexts
from corpuscope.sources.store import VectorStore
from corpuscope.streaming.replay import replay
from corpuscope.streaming.sessions import answered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Memberships of the cache are sharp enough for its index to prune: about a quarter of the entries are candidates.
K, SHARP, CACHE_M = 10, 1.05, 1.01
CACHE_T = 0.30
STOP = ["the", "and", "of", "to", "in", "that", "it", "is", "was", "for", "on", "are", "with", "as", "at", "be", "this", "from", "or", "an", "by", "not"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_as_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def centers(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    return fcm.collected_centers(fcm.label_centers(vectors(spark, sf_dir)))


def members(spark: SparkSession, sf_dir: str, m: float = 2.0) -> DataFrame:
    return fcm.with_memberships(vectors(spark, sf_dir), centers(spark, sf_dir), m)


# --- corpus --------------------------------------------------------------------------------------

WS, STRIP = T.WS, T.STRIP


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '{STRIP}', '', 'g')"


def tokens_sql(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{WS}+'), lambda tk: tk <> ''))"


@query("SELECT source AS category, count(*) AS n FROM documents GROUP BY 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.category_counts(docs_as_corpus(spark, sf_dir))


@query("SELECT DISTINCT source AS category FROM documents")
def category_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.categories(docs_as_corpus(spark, sf_dir))


@query(f"SELECT doc_id, {tokens_sql("coalesce(text, '')")}::INTEGER AS n_tokens FROM documents WHERE {tokens_sql("coalesce(text, '')")} >= 50")
def min_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.long_enough(docs_as_corpus(spark, sf_dir)).select("doc_id", "n_tokens")


@query("SELECT doc_id, source AS category, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1")
def dedup_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_as_corpus(spark, sf_dir).select("category", "doc_id", F.md5("text").alias("md5"))
    return corpus.exact_dedup(docs, digest=F.col("md5")).select("doc_id", "category", F.col("md5").alias("text_md5"))


@query("""SELECT source || '/' || doc_id AS doc_id, source AS category FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 7""")
def head_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.head_per_category(docs_as_corpus(spark, sf_dir), 7, "doc_id").select(F.concat_ws("/", "category", "doc_id").alias("doc_id"), "category")


CLEAN_CTE = f"""
raw AS (SELECT doc_id, source, {RAW_ARTICLE} AS raw FROM documents),
l AS (SELECT *, string_split(raw, chr(10)) AS lines FROM raw),
b AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: {strip_sql("x")} = ''), true), 0) AS pos FROM l),
h AS (SELECT *, CASE WHEN pos = 0 THEN lines WHEN pos = 1 THEN [] ELSE lines[1:pos - 1] END AS header, CASE WHEN pos = 0 THEN [] ELSE lines[pos + 1:] END AS body0 FROM b),
s AS (SELECT *, list_filter(list_transform(header, lambda x: {strip_sql("x")}), lambda x: starts_with(lower(x), 'subject:'))[-1] AS sline,
        coalesce(list_position(list_transform(body0, lambda x: {strip_sql("x")} IN ('--', '---')), true), 0) AS sig FROM h),
c AS (SELECT doc_id, source, {strip_sql(f"regexp_replace({strip_sql('sline[9:]')}, '{T.REPLY_MARK}', '')")} AS subject,
        {strip_sql(f"array_to_string(list_filter(CASE WHEN sig = 0 THEN body0 WHEN sig = 1 THEN [] ELSE body0[1:sig - 1] END, lambda x: NOT starts_with({strip_sql('x')}, '>') AND NOT regexp_matches({strip_sql('x')}, '{T.SEPARATOR}') AND NOT regexp_matches({strip_sql('x')}, '{T.ATTRIBUTION}')), chr(10))")} AS body FROM s),
cleaned AS (SELECT doc_id, source, subject, {strip_sql(f"regexp_replace(regexp_replace(CASE WHEN coalesce(subject, '') <> '' THEN subject || '. ' || body ELSE body END, '{chr(92)}n{{3,}}', chr(10) || chr(10), 'g'), '[ {chr(92)}t]+', ' ', 'g')")} AS text FROM c)"""


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"), F.expr(RAW_ARTICLE).alias("raw_text"))


@query(f"WITH {CLEAN_CTE} SELECT doc_id, text FROM cleaned")
def clean_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_articles(spark, sf_dir).select("doc_id", T.clean_article(F.col("raw_text")).alias("text"))


@query(f"WITH {CLEAN_CTE} SELECT doc_id, subject FROM cleaned")
def subject_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_articles(spark, sf_dir).select("doc_id", T.subject(F.col("raw_text")).alias("subject"))


@query(f"""WITH {CLEAN_CTE} SELECT source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS doc_id, source AS category, md5(text) AS text_md5 FROM cleaned
WHERE {tokens_sql('text')} >= 50 QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1""")
def corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = raw_articles(spark, sf_dir).select("category", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), "raw_text")
    return corpus.load_corpus(articles).select("doc_id", "category", F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, source AS category, md5(coalesce(text, '')) AS text_md5, CAST(doc_id % 3 AS BIGINT) AS batch FROM documents
QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id % 3, source, doc_id) = 1""")
def incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come in three batches, each without the texts that the batches before it kept."""
    articles = docs_as_corpus(spark, sf_dir).select("category", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    articles, out, digest = written(articles, "articles"), new_path(spark, "fresh"), F.col("text_md5")
    seen = SeenTexts(spark, f"seen_{uuid4().hex}", new_path(spark, "seen"))
    for batch in range(3):
        seen.fresh(articles.where(F.col("doc_id") % 3 == batch), batch, digest=digest).write.parquet(f"{out}/batch={batch}")
        seen.add(spark.read.parquet(f"{out}/batch={batch}"), batch, digest=digest)
    seen.drop()
    return spark.read.schema("category string, doc_id long, text_md5 string, batch long").parquet(out)


@query(f"""WITH raw AS (SELECT doc_id, source, {RAW_ARTICLE} AS raw FROM documents)
SELECT source AS category, CASE WHEN doc_id % 10 = 9 THEN doc_id::VARCHAR || '.gz' ELSE doc_id::VARCHAR END AS name, CASE WHEN doc_id % 20 = 19 THEN NULL ELSE md5(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS text_md5,
doc_id % 20 = 19 AS unreadable FROM raw""")
def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written to a file each, some compressed, half of those cut short, and read by the data source."""
    path = new_path(spark, "articles")
    raw = raw_articles(spark, sf_dir).select("category", "doc_id", "raw_text")
    written(raw.mapInArrow(fixtures.writing_files(path), "n long"), "written-articles")
    files = read_files(spark, path, 1 << 20)
    return files.select("category", "name", F.md5("raw_text").alias("text_md5"), F.col("error").isNotNull().alias("unreadable"))


_PREFIXES = ", ".join(f"'{p}'" for p in T.SNIPPET_HEADERS)


def snippet_cte(article: str, source: str = "documents") -> str:
    """Snippets (doc_id, snippet) of an expression over a table with doc_id."""
    return rf"""
n AS (SELECT doc_id, list_transform(string_split(replace({article}, chr(92) || 'n', chr(10)), chr(10)), lambda x: {strip_sql('x')}) AS lines FROM {source}),
k AS (SELECT doc_id, list_filter(lines, lambda x: x <> '' AND NOT starts_with(x, '>') AND NOT starts_with(x, '|')
  AND NOT list_bool_or(list_transform([{_PREFIXES}], lambda p: starts_with(lower(x), p))) AND NOT contains(x, '@')
  AND NOT regexp_matches(x, '{T.LOOSE_ATTRIBUTION}') AND NOT (x = upper(x) AND x <> lower(x) AND {tokens_sql('x')} > 3)
  AND x NOT IN ('--', '---') AND NOT contains(lower(x), 'archive-name') AND NOT contains(lower(x), 'last-modified')) AS lines FROM n),
t AS (SELECT doc_id, lines, len(lines) > 0 AND {tokens_sql("coalesce(lines[1], '')")} <= 10 AS titled FROM k),
p AS (SELECT doc_id, lines, CASE WHEN titled THEN regexp_replace(lines[1], '\.+\z', '') ELSE '' END AS title,
  {strip_sql("regexp_replace(array_to_string(CASE WHEN titled THEN lines[2:] ELSE lines END, ' '), ' {2,}', ' ', 'g')")} AS body FROM t),
r AS (SELECT doc_id, lines, CASE WHEN title <> '' AND length(body) > 80 THEN title || ' — ' || body WHEN body <> '' THEN body ELSE title END AS r FROM p),
g AS (SELECT doc_id, CASE WHEN {tokens_sql('r')} < 10 THEN {strip_sql("regexp_replace(array_to_string(lines, ' '), ' {2,}', ' ', 'g')")} ELSE r END AS r FROM r),
sn AS (SELECT doc_id, CASE WHEN length(r) > 400 THEN regexp_replace(r[1:400], ' [^ ]*\z', '') || '...' ELSE r END AS snippet FROM g)"""


@query(f"WITH {snippet_cte(NOISY_ARTICLE)} SELECT doc_id, snippet FROM sn")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(NOISY_ARTICLE).alias("stored"))
    return docs.select("doc_id", T.snippet(F.col("stored")).alias("snippet"))


# --- vectors -------------------------------------------------------------------------------------

E_CTE = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query(f"WITH {E_CTE} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(list_dot_product(v, v) / list_dot_product(v, v), 6) AS unit_norm FROM e")
def l2_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return rows.select("id", r6(V.norm(F.col("vec"))).alias("norm"), r6(V.norm(V.l2_normalize(F.col("vec")))).alias("unit_norm"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return knn.pair_similarity(rows.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), rows)


PAIRS_CTE = f"{E_CTE}, s AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS sim FROM e a JOIN e b ON b.id = a.id + 1)"


@query(f"WITH {PAIRS_CTE} SELECT a, b, round(sim, 6) + 0.0 AS similarity FROM s")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", r6("similarity").alias("similarity"))


@query(f"""WITH {PAIRS_CTE} SELECT threshold, count(*) AS n_pairs, CAST(sum(CASE WHEN sim >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS hits,
round(100 * sum(CASE WHEN sim >= threshold THEN 1 ELSE 0 END) / count(*), 0) AS hit_pct
FROM s, (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold) GROUP BY 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.threshold_sweep(_pairs(spark, sf_dir), [0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95])


@query(f"WITH {PAIRS_CTE} SELECT a, b, CASE WHEN sim >= 0.1 THEN 'HIT' ELSE 'MISS' END AS verdict FROM s")
def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.when(F.col("similarity") >= 0.1, "HIT").otherwise("MISS").alias("verdict"))


def _knn_sql(where: str = "true", k: int = 5, queries: str = "id % 50 = 0") -> str:
    return f"""WITH {E_CTE}, q AS (SELECT * FROM e WHERE {queries})
SELECT query_id, item_id, rank, similarity FROM (
  SELECT q.id AS query_id, e.id AS item_id, CAST(row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, e.v) DESC, e.id) AS INTEGER) AS rank, round(list_dot_product(q.v, e.v), 4) + 0.0 AS similarity
  FROM q, e WHERE {where}) WHERE rank <= {k}"""


@query(_knn_sql(queries="id = 0").replace("query_id, item_id, rank, similarity FROM", "item_id, similarity FROM", 1))
def knn_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    first = rows.where("id = 0").first()
    return knn.knn_single(rows, first.vec if first else [], 5, "id", "vec").select(F.col("id").alias("item_id"), (F.round("similarity", 4) + 0.0).alias("similarity"))


def _batch(spark: SparkSession, sf_dir: str, where: dict | None = None) -> DataFrame:
    rows = vectors(spark, sf_dir)
    items = rows.select(F.col("id").alias("item_id"), "vec", "label")
    found = knn.knn_batch(items, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), 5, where)
    return found.select("query_id", "item_id", "rank", (F.round("score", 4) + 0.0).alias("similarity"))


@query(_knn_sql())
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir)


@query(_knn_sql("e.label IN (1, 2, 3) OR e.label >= 8"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir, {"$or": [{"label": {"$in": [1, 2, 3]}}, {"label": {"$gte": 8}}]})


#: Lists of the stored index, and how many of them a query probes; the test vectors lie in almost all directions alike, so it takes many.
IVF_LISTS, IVF_PROBES = 32, 24


@query()
def ivf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest by a stored inverted file, which reads the lists that are probed; recall is measured in the README."""
    rows = vectors(spark, sf_dir).select(F.col("id").alias("item_id"), "vec")
    index = knn.IvfIndex(IVF_LISTS).fit(rows)
    stored = index.store(rows, new_path(spark, "ivf"))
    asked = rows.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "vec")
    return index.search(stored, asked, 10, IVF_PROBES).select("query_id", "item_id", "rank", (F.round("score", 4) + 0.0).alias("similarity"))


RESULT_CTE = f"""{E_CTE}, {snippet_cte("coalesce(text, '')")},
near AS (SELECT q.id AS query_id, e.id AS item_id, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, e.v) DESC, e.id) AS rank, list_dot_product(q.v, e.v) AS sim
  FROM (SELECT * FROM e WHERE id % 50 = 0) q, e QUALIFY rank <= 5)"""


@query(f"""WITH {RESULT_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(item_id AS VARCHAR) AS doc_id, coalesce(nullif(source, 'src3'), 'unknown') AS category, coalesce(snippet, '') AS text_snippet,
round(sim, 4) + 0.0 AS similarity, CASE WHEN item_id % 3 = 0 THEN -1 ELSE CAST(item_id % 3 AS INTEGER) END AS cluster
FROM near LEFT JOIN documents d ON d.doc_id = item_id LEFT JOIN sn ON sn.doc_id = item_id""")
def result_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results as they are shown: some categories and clusters are missing and get their defaults."""
    rows = vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.nullif("source", F.lit("src3")).alias("category"), "text")
    third = (F.col("id") % 3).cast("int")
    items = rows.join(docs, rows.id == docs.doc_id, "left").select(F.col("id").alias("item_id"), F.col("id").alias("doc_id"), "category", "text", F.when(third > 0, third).alias("dominant_cluster"))
    found = knn.knn_batch(rows.select(F.col("id").alias("item_id"), "vec"), rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), 5)
    shown = search.result_rows(found, items).select("query_id", F.posexplode("result").alias("at", "r"))
    return shown.select("query_id", (F.col("at") + 1).alias("rank"), "r.doc_id", "r.category", "r.text_snippet", (F.col("r.similarity") + 0.0).alias("similarity"), "r.cluster")


@query(f"""WITH {E_CTE}, c AS (SELECT e.id, label, list(x - m ORDER BY dim) AS v FROM (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e) e
  JOIN (SELECT dim, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e) GROUP BY 1) USING (dim) GROUP BY 1, 2)
SELECT a.id, round(list_dot_product(a.v, a.v), 6) AS norm, round(list_dot_product(a.v, b.v), 6) + 0.0 AS with_first FROM c a, (SELECT v FROM c ORDER BY id LIMIT 1) b""")
def pca_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together keep the products of centered vectors: each with itself and with the first one."""
    rows = vectors(spark, sf_dir).select("id", "vec")
    reduced = written(CenteredPCA(1 << 20).fit(rows).transform(rows).select("id", "reduced"), "reduced")
    first = F.array(*[F.lit(float(x)) for x in reduced.orderBy("id").first().reduced])
    return reduced.select("id", r6(V.dot(F.col("reduced"), F.col("reduced"))).alias("norm"), r6(V.dot(F.col("reduced"), first)).alias("with_first"))


# --- soft clusters -------------------------------------------------------------------------------


def fcm_cte(m: float, name: str = "u", cent: str = "cent") -> str:
    """Memberships (id, label, u as list) from centers (cluster, c as list)."""
    p = 2.0 / (m - 1)
    return f"""{name}_d AS (SELECT e.id, cluster, greatest(list_sum(list_transform(list_zip(e.v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 2.220446049250313e-16) AS d FROM e, {cent}),
{name}_w AS (SELECT id, cluster, power(min(d) OVER (PARTITION BY id) / d, {p}) AS w FROM {name}_d),
{name} AS (SELECT id, list(w / s ORDER BY cluster) AS u FROM (SELECT *, sum(w) OVER (PARTITION BY id) AS s FROM {name}_w) GROUP BY id)"""


CENT_CTE = f"""{E_CTE}, cent AS (SELECT label AS cluster, list(x ORDER BY dim) AS c FROM (
  SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e) GROUP BY 1, 2) GROUP BY 1)"""


def u_cte(m: float = 2.0) -> str:
    return f"{CENT_CTE}, {fcm_cte(m)}"


@query(f"""WITH {u_cte()} SELECT CAST(e.id AS VARCHAR) AS doc_id, source AS category, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS dominant_cluster, round(list_max(u), 4) + 0.0 AS top_p, round(sqrt(list_dot_product(v, v)), 4) AS norm
FROM e JOIN u USING (id) LEFT JOIN documents ON doc_id = e.id""")
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written to a store in two parts, updated with their clusters, and read back."""
    store = VectorStore(spark, new_path(spark, "store"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "text")
    rows = vectors(spark, sf_dir).join(docs, "id", "left").select(F.col("id").cast("string").alias("doc_id"), F.col("vec").alias("embedding"), "text", "category", (F.col("id") % 2).alias("half"))
    store.add(rows.where("half = 0"), "errorifexists")
    store.add(rows.where("half = 1"))
    store.add(rows, "ignore")
    found = fcm.assignments(members(spark, sf_dir)).select(F.col("id").cast("string").alias("doc_id"), "dominant_cluster", "cluster_probs")
    store.update(found)
    return store.frame().select("doc_id", "category", "dominant_cluster", (F.col("cluster_probs")[0].p + 0.0).alias("top_p"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query(f"WITH {CENT_CTE} SELECT cluster, CAST(dim - 1 AS INTEGER) AS dim, round(x, 6) + 0.0 AS value FROM (SELECT cluster, unnest(c) AS x, generate_subscripts(c, 1) AS dim FROM cent)")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fcm.label_centers(vectors(spark, sf_dir)).select("cluster", "dim", r6("value").alias("value"))


def _membership_rows(m: float) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        long = members(spark, sf_dir, m).select("id", F.posexplode("memberships").alias("cluster", "p"))
        return long.select("id", "cluster", r6("p").alias("p"))

    return run, f"WITH {u_cte(m)} SELECT id, CAST(k - 1 AS INTEGER) AS cluster, round(p, 6) + 0.0 AS p FROM (SELECT id, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM u)"


QUERIES["fcm_memberships"], ORACLE_SQL["fcm_memberships"] = _membership_rows(2.0)
QUERIES["fcm_memberships_sharp"], ORACLE_SQL["fcm_memberships_sharp"] = _membership_rows(SHARP)

NEXT = """{n}_x AS (SELECT cluster, dim, sum(w * x) / sum(w) AS x FROM (
  SELECT k AS cluster, power(p, 2.0) AS w, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM (SELECT {u}.id, unnest(u) AS p, generate_subscripts(u, 1) - 1 AS k FROM {u}) JOIN e USING (id)) GROUP BY 1, 2),
{n} AS (SELECT cluster, list(x ORDER BY dim) AS c FROM {n}_x GROUP BY 1)"""


@query(f"WITH {u_cte()}, {NEXT.format(n='nxt', u='u')} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(dim - 1 AS INTEGER) AS dim, round(x, 6) + 0.0 AS value FROM nxt_x")
def fcm_center_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).select("id", "vec", "memberships")
    num, den, _, _ = fcm._sums(rows, 2.0, 2.0, None, None)
    c = num / den[:, None]
    made = [(i, j, float(c[i, j])) for i in range(c.shape[0]) for j in range(c.shape[1])]
    return spark.createDataFrame(made, "cluster int, dim int, value double").select("cluster", "dim", r6("value").alias("value"))


START = "SELECT id, list_transform(range(0, 10), lambda k: (1 + (id * 31 + k * 17) % 7)::DOUBLE / list_sum(list_transform(range(0, 10), lambda j: 1 + (id * 31 + j * 17) % 7))) AS u FROM e"
FIT_CTE = f"{E_CTE}, u0 AS ({START}), {NEXT.format(n='c1', u='u0')}, {fcm_cte(2.0, 'u1', 'c1')}, {NEXT.format(n='c2', u='u1')}, {fcm_cte(2.0, 'u2', 'c2')}"


def _two_rounds(spark: SparkSession, sf_dir: str) -> tuple[fcm.FuzzyCMeans, DataFrame]:
    raw = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: 1 + (F.col("id") * 31 + k * 17) % 7)
    total = F.aggregate(raw, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = written(vectors(spark, sf_dir).withColumn("memberships", F.transform(raw, lambda x: x / total)), "fcm-rows")
    return fcm.FuzzyCMeans(k=K, max_iter=2, tol=0.0).fit(rows), rows


@query(f"WITH {FIT_CTE} SELECT id, CAST(k - 1 AS INTEGER) AS cluster, round(p, 6) + 0.0 AS p FROM (SELECT id, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM u2)")
def fcm_fit_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = _two_rounds(spark, sf_dir)
    long = model.transform(rows.drop("memberships")).select("id", F.posexplode("memberships").alias("cluster", "p"))
    return long.select("id", "cluster", r6("p").alias("p"))


@query(ORACLE_SQL["fcm_fit_fixed"])
def ml_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduction and clustering as a pipeline of Spark's, fitted, saved and loaded; all components together keep distances."""
    _, rows = _two_rounds(spark, sf_dir)
    path = new_path(spark, "pipeline")
    Pipeline(stages=[stages.Reduction(k=1 << 20), stages.SoftClusters(k=K, maxIter=2, tol=0.0, startCol="memberships")]).fit(rows).write().save(path)
    long = PipelineModel.load(path).transform(rows.drop("memberships")).select("id", F.posexplode("memberships").alias("cluster", "p"))
    return long.select("id", "cluster", r6("p").alias("p"))


@query(f"""WITH {FIT_CTE} SELECT round((SELECT max(abs(a - b)) FROM (SELECT unnest(u1.u) AS a, unnest(u2.u) AS b FROM u1 JOIN u2 USING (id))), 6) AS delta,
round((SELECT sum(power(p, 2.0) * d) FROM (SELECT id, unnest(u) AS p, generate_subscripts(u, 1) - 1 AS cluster FROM u2) JOIN u2_d USING (id, cluster)), 4) AS inertia""")
def fcm_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = _two_rounds(spark, sf_dir)
    return spark.createDataFrame([(round(model.delta, 6), round(model.inertia, 4))], "delta double, inertia double")


@query(f"WITH {u_cte()} SELECT id, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS dominant_cluster FROM u")
def dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select("id", V.argmax(F.col("memberships")).alias("dominant_cluster"))


@query(f"WITH {u_cte()} SELECT CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS cluster, count(*) AS n FROM u GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cluster_sizes(members(spark, sf_dir).withColumn("dominant_cluster", V.argmax(F.col("memberships"))))


@query(f"""WITH {u_cte()}, t AS (SELECT id, k - 1 AS cluster, p, row_number() OVER (PARTITION BY id ORDER BY p DESC, k) AS rank FROM (SELECT id, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM u))
SELECT id, CAST(rank AS INTEGER) AS rank, CAST(cluster AS INTEGER) AS cluster, round(p, 4) + 0.0 AS p FROM t WHERE rank <= 3""")
def cluster_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fcm.assignments(members(spark, sf_dir)).select("id", F.posexplode("cluster_probs").alias("at", "x"))
    return rows.select("id", (F.col("at") + 1).alias("rank"), "x.cluster", "x.p")


@query(f"""WITH {E_CTE}, d AS (SELECT a.id, a.label, b.label AS other, sum(CASE WHEN a.id = b.id THEN 0 ELSE sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END) AS total, count(*) AS n FROM e a, e b GROUP BY ALL),
s AS (SELECT id, max(CASE WHEN label = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM d GROUP BY id)
SELECT round(avg(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*) AS n FROM s""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all rows, none sampled."""
    rows = vectors(spark, sf_dir).select("id", "vec", F.col("label").alias("cluster"))
    return quality.silhouette(rows, sample=None).select(r6("silhouette").alias("silhouette"), "n")


@query(f"""WITH {E_CTE}, d AS (SELECT a.id, a.label, b.label AS other, sum(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS total, count(*) AS n FROM e a, e b GROUP BY ALL),
s AS (SELECT id, label, max(CASE WHEN label = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM d GROUP BY id, label)
SELECT id, label AS cluster, round(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END, 6) + 0.0 AS silhouette FROM s""")
def silhouette_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row, in squared distance."""
    rows = vectors(spark, sf_dir).select("id", "vec", F.col("label").alias("cluster"))
    return quality.linear_silhouettes(rows).select("id", "cluster", r6("silhouette").alias("silhouette"))


ENTROPY_CTE = f"{u_cte()}, h AS (SELECT id, u, -list_sum(list_transform(u, lambda p: p * ln(p + 1e-10))) AS h FROM u)"


@query(f"WITH {ENTROPY_CTE} SELECT id, round(h, 6) AS entropy FROM h")
def membership_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir).select("id", r6(V.entropy(F.col("memberships"))).alias("entropy"))


@query(f"""WITH {ENTROPY_CTE}, t AS (SELECT h.id, h.h, d.source AS category, left(d.text, 200) || '...' AS preview, list_position(u, list_max(u)) AS a, u FROM h JOIN documents d ON d.doc_id = h.id ORDER BY h.h DESC, h.id LIMIT 10)
SELECT id, category, round(h, 6) AS entropy, CAST(a - 1 AS INTEGER) AS first_cluster, CAST(list_position(u, list_max(list_filter(u, lambda p, i: i <> a))) - 1 AS INTEGER) AS second_cluster, preview FROM t""")
def boundary_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), "text")
    found = quality.boundary_documents(members(spark, sf_dir).join(docs, "id"))
    return found.select("id", "category", r6("entropy").alias("entropy"), "first_cluster", "second_cluster", F.concat(F.substring("text", 1, 200), F.lit("...")).alias("preview"))


W_CTE = f"""{u_cte()}, cw AS (SELECT CAST(k - 1 AS INTEGER) AS cluster, source AS category, sum(p) AS weight FROM (
  SELECT id, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM u) JOIN documents ON doc_id = id GROUP BY 1, 2)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"))
    return terms.category_weights(members(spark, sf_dir).join(docs, "id").select("category", "memberships"), K)


@query(f"WITH {W_CTE} SELECT cluster, category, round(weight, 6) AS weight FROM cw")
def category_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("cluster", "category", r6("weight").alias("weight"))


@query(f"WITH {W_CTE} SELECT cluster, category, CAST(row_number() OVER (PARTITION BY cluster ORDER BY weight DESC, category) AS INTEGER) AS rank FROM cw QUALIFY rank <= 3")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.top_categories(_weights(spark, sf_dir)).select("cluster", "category", "rank")


_STOP = ", ".join(f"'{w}'" for w in STOP)
TFIDF_CTE = rf"""tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{terms.TOKEN}')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok WHERE term NOT IN ({_STOP}) GROUP BY 1, 2),
voc AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 3 ORDER BY total DESC, term LIMIT 20000),
w AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term)),
tfidf AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS tfidf FROM w)"""


def _tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tfidf(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), stop_words=STOP)


@query(f"WITH {TFIDF_CTE} SELECT id, term, round(tfidf, 6) + 0.0 AS tfidf FROM tfidf")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(spark, sf_dir).select("id", "term", r6("tfidf").alias("tfidf"))


@query(f"""WITH {u_cte()}, {TFIDF_CTE}, sc AS (SELECT CAST(k - 1 AS INTEGER) AS cluster, term, sum(tfidf * p) AS score FROM tfidf JOIN (SELECT id, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM u) USING (id) GROUP BY 1, 2)
SELECT cluster, term, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10""")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = terms.top_terms(_tfidf(spark, sf_dir), members(spark, sf_dir), K)
    return got.select("cluster", "term", r6("score").alias("score"), "rank")


@query()
def latent_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents along the leading directions of their own TF-IDF matrix; tests hold them against an exact decomposition."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    encoder = LatentEncoder(32, stop_words=STOP).fit(docs)
    return docs.select("id", F.transform(encoder(F.col("text")), lambda x: F.round(x, 4) + 0.0).alias("vector"))


@query(f"""WITH {u_cte()} SELECT CAST(k - 1 AS INTEGER) AS cluster, {", ".join(f'round(max(CASE WHEN id = {i} THEN p END), 6) AS d{i}' for i in range(5))}
FROM (SELECT id, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM u) GROUP BY 1""")
def membership_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.heat_map(members(spark, sf_dir), list(range(5)))
    return got.select("cluster", *[r6(f"`{i}`").alias(f"d{i}") for i in range(5)])


@query(f"""WITH {u_cte()}, s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4'))
SELECT doc_id, source AS category, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS dominant_cluster FROM s JOIN u ON id = doc_id WHERE r <= 5""")
def category_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = corpus.sample_per_category(docs_as_corpus(spark, sf_dir), ["src1", "src2", "src3", "src4"])
    return few.join(members(spark, sf_dir), few.doc_id == F.col("id")).select("doc_id", "category", V.argmax(F.col("memberships")).alias("dominant_cluster"))


@query(f"""WITH {CENT_CTE}, {fcm_cte(2.0)}
SELECT id, CAST(k - 1 AS INTEGER) AS cluster, round(p, 6) + 0.0 AS p, CAST(list_position(u, list_max(u)) - 1 AS INTEGER) AS dominant_cluster FROM (SELECT id, u, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM u)""")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduction and clusters, saved, loaded again and applied one after the other.

    All components together keep distances, so the memberships are those of the vectors as they are.
    """
    rows = vectors(spark, sf_dir).select("id", "vec")
    pca = CenteredPCA(1 << 20).fit(rows)
    own = (centers(spark, sf_dir) - pca.mean) @ pca.components
    path = new_path(spark, "model")
    pca.save(spark, f"{path}/pca")
    fcm.FuzzyCMeans(k=len(own), centers=own).save(spark, f"{path}/fcm")
    pca, model = CenteredPCA.load(spark, f"{path}/pca"), fcm.FuzzyCMeans.load(spark, f"{path}/fcm")
    found = model.predict(pca.transform(rows), "reduced")
    return found.select("id", F.posexplode("memberships").alias("cluster", "p"), "dominant_cluster").select("id", "cluster", r6("p").alias("p"), "dominant_cluster")


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return CenteredPCA(8).fit(rows).transform(rows).select("id", F.transform("reduced", lambda x: F.round(F.abs(x), 6)).alias("reduced"))


def _sweep_sql(k: int) -> str:
    """One row of the sweep: two rounds from the given start, then silhouette and objective."""
    return f"""(WITH {FIT_CTE.replace("range(0, 10)", f"range(0, {k})")}, lab AS (SELECT e.id, v, list_position(u, list_max(u)) AS label FROM e JOIN u2 USING (id)),
d AS (SELECT a.id, a.label, b.label AS other, sum(CASE WHEN a.id = b.id THEN 0 ELSE sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) END) AS total, count(*) AS n FROM lab a, lab b GROUP BY ALL),
sil AS (SELECT id, max(CASE WHEN label = other THEN total / greatest(n - 1, 1) END) AS a, min(CASE WHEN label <> other THEN total / n END) AS b, max(CASE WHEN label = other THEN n END) AS n FROM d GROUP BY id)
SELECT CAST({k} AS INTEGER) AS k, (SELECT avg(CASE WHEN n > 1 AND b IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0 END) FROM sil) AS silhouette,
(SELECT sum(power(p, 2.0) * d) FROM (SELECT id, unnest(u) AS p, generate_subscripts(u, 1) - 1 AS cluster FROM u2) JOIN u2_d USING (id, cluster)) AS inertia)"""


def given_start(k: int) -> Column:
    """The starting memberships of the fits that SQL repeats."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: 1 + (F.col("id") * 31 + c * 17) % 7)
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0).cast("long"), lambda a, y: a + y))


@query(f"""SELECT k, round(silhouette, 6) AS silhouette, round(inertia, 4) AS inertia, CAST(2 AS INTEGER) AS iterations, silhouette = max(silhouette) OVER () AS best
FROM ({" UNION ALL ".join(_sweep_sql(k) for k in (3, 5, 8))})""")
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("id", "vec")
    got = quality.k_sweep(rows, (3, 5, 8), start=given_start, sample=None, max_iter=2, tol=0.0)
    return got.select("k", r6("silhouette").alias("silhouette"), F.round("inertia", 4).alias("inertia"), "iterations", "best")


# --- cache ---------------------------------------------------------------------------------------


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = members(spark, sf_dir, CACHE_M).where("id % 2 = 0")
    return even.select(F.floor(F.col("id") / 2).alias("entry_idx"), F.concat(F.lit("q"), F.col("id")).alias("query"), F.col("vec").alias("query_embedding"), F.col("memberships").alias("cluster_memberships"), V.argmax(F.col("memberships")).alias("dominant_cluster"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir, CACHE_M).where("id % 2 = 1").select(F.col("id").alias("query_id"), F.concat(F.lit("q"), F.col("id")).alias("query"), "vec", "memberships")


CACHE_CTE = f"""{u_cte(CACHE_M)},
m AS (SELECT e.id, v, u, list_position(u, list_max(u)) AS top FROM e JOIN u USING (id)),
en AS (SELECT id // 2 AS entry_idx, * FROM m WHERE id % 2 = 0), qs AS (SELECT * FROM m WHERE id % 2 = 1),
ix AS (SELECT entry_idx, k FROM (SELECT entry_idx, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM en) WHERE p >= 0.05),
pr AS (SELECT id, k FROM (SELECT id, top, unnest(u) AS p, generate_subscripts(u, 1) AS k FROM qs) WHERE p >= 0.05 OR k = top),
ca AS (SELECT DISTINCT pr.id, entry_idx FROM pr JOIN ix USING (k)),
sc AS (SELECT ca.id, ca.entry_idx, list_dot_product(qs.v, en.v) AS score FROM ca JOIN qs ON qs.id = ca.id JOIN en ON en.entry_idx = ca.entry_idx),
bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, entry_idx) = 1),
lk AS (SELECT qs.id AS query_id, coalesce(score >= {CACHE_T}, false) AS hit, CASE WHEN score >= {CACHE_T} THEN bs.entry_idx END AS entry_idx, CASE WHEN score >= {CACHE_T} THEN score END AS score FROM qs LEFT JOIN bs ON bs.id = qs.id)"""


@query(f"WITH {CACHE_CTE} SELECT CAST(k - 1 AS INTEGER) AS cluster, entry_idx FROM ix")
def cache_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.cluster_index(_entries(spark, sf_dir))


@query(f"WITH {CACHE_CTE} SELECT CAST(c AS INTEGER) AS cluster, (SELECT count(*) FROM ix WHERE k = c + 1) AS n FROM range(0, 10) t(c)")
def cache_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.distribution(_entries(spark, sf_dir), K)


@query(f"WITH {CACHE_CTE} SELECT qs.id AS query_id, count(ca.entry_idx) AS n_candidates FROM qs LEFT JOIN ca USING (id) GROUP BY 1")
def cache_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.candidate_counts(_questions(spark, sf_dir), _entries(spark, sf_dir))


def _stored_cache(spark: SparkSession, sf_dir: str) -> cache.SemanticCache:
    """The entries in a cache of their own folder."""
    even = members(spark, sf_dir, CACHE_M).where("id % 2 = 0")
    rows = even.select(F.col("id").alias("query_id"), F.concat(F.lit("q"), F.col("id")).alias("query"), "vec", "memberships", F.lit(None).cast(cache.RESULT).alias("result"))
    stored = cache.SemanticCache(spark, new_path(spark, "cache"), K, CACHE_T)
    stored.store(rows)
    return stored


@query(f"WITH {CACHE_CTE} SELECT query_id, hit, entry_idx, round(score, 6) AS score FROM lk")
def cache_lookup_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup through vectors that are stored by cluster, of which only the probed clusters are read."""
    return _stored_cache(spark, sf_dir).lookup(_questions(spark, sf_dir)).select("query_id", "hit", "entry_idx", r6("score").alias("score"))


@query(f"""WITH {CACHE_CTE} SELECT (SELECT count(*) FROM en) AS entries_cleared, CAST(0 AS BIGINT) AS total_entries, CAST(0 AS BIGINT) AS hit_count, CAST(0 AS BIGINT) AS miss_count, CAST(0 AS DOUBLE) AS hit_rate,
(SELECT count(*) FROM qs) AS misses_after""")
def cache_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored cache after lookups, flushed: its counters, and how many of the same queries then miss."""
    stored, asked = _stored_cache(spark, sf_dir), _questions(spark, sf_dir)
    stored.lookup(asked)
    cleared = stored.flush()
    misses = stored.lookup(asked).where("NOT hit").agg(F.count(F.lit(1)).alias("misses_after"))
    now = stored.stats().select("total_entries", "hit_count", "miss_count", "hit_rate")
    return now.select(F.lit(cleared).cast("long").alias("entries_cleared"), "*").crossJoin(F.broadcast(misses))  # a row each


@query(f"WITH {CACHE_CTE} SELECT query_id, hit, entry_idx, round(score, 6) AS score FROM lk")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cache.lookup(_questions(spark, sf_dir), _entries(spark, sf_dir), CACHE_T)
    return got.select("query_id", "hit", "entry_idx", r6("score").alias("score"))


@query(f"""WITH {CACHE_CTE} SELECT (SELECT count(*) FROM en) AS total_entries, CAST(sum(hit::INT) AS BIGINT) AS hit_count, CAST(sum((NOT hit)::INT) AS BIGINT) AS miss_count, round(sum(hit::INT) / count(*), 4) AS hit_rate,
CAST({CACHE_T} AS DOUBLE) AS threshold FROM lk""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    log = cache.lookup(_questions(spark, sf_dir), entries, CACHE_T)
    return cache.stats(log, entries, K, CACHE_T).drop("cluster_distribution")


@query(f"""WITH {CACHE_CTE} SELECT en.entry_idx, 'q' || en.id AS query, CAST(en.top - 1 AS INTEGER) AS dominant_cluster, count(lk.query_id) AS hit_count, (SELECT count(*) FROM en) + (SELECT count(*) FROM lk WHERE hit) AS logged
FROM en LEFT JOIN lk ON lk.entry_idx = en.entry_idx AND hit GROUP BY ALL""")
def cache_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and log of a stored cache, read back by another one on the same folder."""
    first = _stored_cache(spark, sf_dir)
    first.lookup(_questions(spark, sf_dir))
    again = cache.SemanticCache(spark, first.path, K, CACHE_T)
    logged = again.log().agg(F.count(F.lit(1)).alias("logged"))
    entries = again.entries().join(again.hit_counts(), "entry_idx", "left").crossJoin(F.broadcast(logged))  # one row
    return entries.select("entry_idx", "query", "dominant_cluster", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "logged")


@query(f"""WITH {CACHE_CTE}, knn AS (SELECT a.id, b.id AS item, row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS r FROM m a, m b QUALIFY r <= 5),
top AS (SELECT id, string_agg(item::VARCHAR, ',' ORDER BY r) AS ids FROM knn GROUP BY 1)
SELECT query_id, hit AS cache_hit, CASE WHEN hit THEN 'q' || lk.entry_idx * 2 END AS matched_query, round(score, 4) AS similarity_score,
  CAST(CASE WHEN hit THEN en.top ELSE qs.top END - 1 AS INTEGER) AS dominant_cluster, top.ids AS result_ids
FROM lk JOIN qs ON qs.id = query_id LEFT JOIN en ON en.entry_idx = lk.entry_idx JOIN top ON top.id = CASE WHEN hit THEN lk.entry_idx * 2 ELSE query_id END""")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, rows = _entries(spark, sf_dir), vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("source").alias("category"), "text")
    items = rows.join(docs, rows.id == docs.doc_id, "left").select(F.col("id").alias("item_id"), F.col("id").alias("doc_id"), "category", "text", F.lit(None).cast("int").alias("dominant_cluster"))
    stored = search.result_rows(knn.knn_batch(rows.select(F.col("id").alias("item_id"), "vec"), entries.select(F.col("entry_idx").alias("query_id"), F.col("query_embedding").alias("vec")), 5), items)
    full = entries.join(stored.withColumnRenamed("query_id", "entry_idx"), "entry_idx")
    got = search.answer(_questions(spark, sf_dir), full, rows.select(F.col("id").alias("item_id"), "vec"), items, 5, CACHE_T)
    ids = F.array_join(F.transform("result", lambda r: r.doc_id), ",")
    return got.select("query_id", "cache_hit", "matched_query", "similarity_score", "dominant_cluster", ids.alias("result_ids"))


@query(f"""WITH RECURSIVE {E_CTE},
near AS (SELECT a.id, list({{'i': b.id, 's': list_dot_product(a.v, b.v)}} ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS c FROM e a JOIN e b ON b.id < a.id AND list_dot_product(a.v, b.v) >= {CACHE_T} GROUP BY 1),
q AS (SELECT e.id, row_number() OVER (ORDER BY e.id) AS n, coalesce(c, []) AS c FROM e LEFT JOIN near USING (id)),
r(n, id, stored, found) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS STRUCT(i BIGINT, s DOUBLE))
  UNION ALL
  SELECT q.n, q.id, CASE WHEN len(list_filter(q.c, lambda x: list_contains(r.stored, x.i))) = 0 THEN list_append(r.stored, q.id) ELSE r.stored END, list_filter(q.c, lambda x: list_contains(r.stored, x.i))[1]
  FROM r JOIN q ON q.n = r.n + 1)
SELECT id AS query_id, found IS NOT NULL AS hit, CAST(list_position(stored, found.i) - 1 AS BIGINT) AS entry_idx, round(found.s, 6) AS score FROM r WHERE n > 0""")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("id").alias("query_id"), "vec", F.array(F.lit(1.0)).alias("memberships"))
    return replay(rows, CACHE_T).select("query_id", "hit", "entry_idx", r6("score").alias("score"))


#: Turns of a conversation that have about the same letters are alike.
SESSION_T = 0.97


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS x FROM conversations),
c AS (SELECT conv_id, turn, list_transform(range(97, 123), lambda k: (length(x) - length(replace(x, chr(k::INTEGER), '')))::DOUBLE) AS c FROM t),
v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, list_transform(c, lambda y: y / greatest(sqrt(list_dot_product(c, c)), 1.0)) AS v FROM c),
near AS (SELECT a.conv_id, a.n, list({{'i': b.n, 's': list_dot_product(a.v, b.v)}} ORDER BY list_dot_product(a.v, b.v) DESC, b.n) AS c FROM v a JOIN v b ON b.conv_id = a.conv_id AND b.n < a.n AND list_dot_product(a.v, b.v) >= {SESSION_T} GROUP BY 1, 2),
q AS (SELECT v.conv_id, v.n, turn, coalesce(c, []) AS c FROM v LEFT JOIN near ON near.conv_id = v.conv_id AND near.n = v.n),
r(conv_id, n, turn, stored, found) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS STRUCT(i BIGINT, s DOUBLE)) FROM v
  UNION ALL
  SELECT r.conv_id, q.n, q.turn, CASE WHEN len(list_filter(q.c, lambda x: list_contains(r.stored, x.i))) = 0 THEN list_append(r.stored, q.n) ELSE r.stored END, list_filter(q.c, lambda x: list_contains(r.stored, x.i))[1]
  FROM r JOIN q ON q.conv_id = r.conv_id AND q.n = r.n + 1)
SELECT conv_id, turn AS query_id, found IS NOT NULL AS hit, CAST(list_position(stored, found.i) - 1 AS BIGINT) AS entry_idx, round(found.s, 6) AS score FROM r WHERE n > 0""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as sessions of a stream, their turns in two batches; the state of the first is found by a second run."""
    text = F.lower(F.coalesce("text", F.lit("")))
    letters = F.transform(F.sequence(F.lit(97), F.lit(122)), lambda k: (F.length(text) - F.length(F.replace(text, F.char(k), F.lit("")))).cast("double"))
    size = F.greatest(V.norm(letters), F.lit(1.0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("query_id"), V.let(size, lambda n: F.transform(letters, lambda x: x / n)).alias("vec"), F.array(F.lit(1.0)).alias("memberships"))
    rows, came, out, state = written(rows, "turns"), new_path(spark, "came"), new_path(spark, "answers"), new_path(spark, "state")
    for late in (False, True):
        rows.where((F.col("query_id") >= 3) == late).write.mode("append").parquet(came)
        found = answered(spark.readStream.schema(rows.schema).parquet(came), out, state, SESSION_T, session="conv_id")
    return found.select("conv_id", "query_id", "hit", "entry_idx", r6("score").alias("score"))


# --- the engine as a whole -----------------------------------------------------------------------


@query(f"""WITH {CLEAN_CTE}, kept AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 9, '0') AS doc_id, source, text, doc_id AS id FROM cleaned
  WHERE {tokens_sql('text')} >= 50 QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) = 1)
SELECT id AS query_id, false AS first_hit, CAST(least(5, (SELECT count(*) FROM kept)) AS INTEGER) AS n_results, 1.0::DOUBLE AS top_similarity, true AS second_hit, 1.0::DOUBLE AS second_similarity,
(SELECT count(*) FROM kept) AS n_stored, (SELECT count(*) FROM kept WHERE id % 50 = 0) AS n_entries FROM kept WHERE id % 50 = 0""")
def engine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles ingested into an engine and asked for by their own texts, twice: first searched for, then answered by the cache."""
    engine = search.Engine(spark, new_path(spark, "engine"), k=K)
    articles = raw_articles(spark, sf_dir).select("category", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), "raw_text")
    stored = engine.ingest(articles)
    number = F.substring_index("doc_id", "/", -1).cast("long")
    asked = engine.store.frame().select(number.alias("query_id"), F.col("text").alias("query")).where("query_id % 50 = 0")
    first, second = engine.search(asked, 5), engine.search(asked, 1)
    one = first.select("query_id", F.col("cache_hit").alias("first_hit"), F.size("result").alias("n_results"), F.element_at("result", 1).similarity.alias("top_similarity"))
    two = second.select("query_id", F.col("cache_hit").alias("second_hit"), F.col("similarity_score").alias("second_similarity"))
    entries = engine.cache_stats()["total_entries"]
    return one.join(two, "query_id").select("*", F.lit(stored).cast("long").alias("n_stored"), F.lit(entries).cast("long").alias("n_entries"))
