"""The labelled corpus: files, cleaning, filtering, exact deduplication, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.functions.text import clean_article, token_count

MIN_TOKENS = 50
CORPUS_SCHEMA = "doc_id string, category string, text string, raw_text string"


def decode(content: Column) -> Column:
    """Strict UTF-8, else Latin-1; all line ends become newlines."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(path)


def unreadable(spark: SparkSession, path: str) -> int:
    """How many of the files that are listed below a path cannot be read.

    Listing alone gives a row for each file; reading content drops those that fail.
    """
    files = _files(spark, path)
    return files.select("path").count() - files.where(F.length("content") >= 0).count()


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """(category, name, raw_text) of a directory for each category with a file for each article.

    Unreadable files are skipped by Spark's own reader option; ``unreadable`` counts them.
    """
    files = _files(spark, path)
    at = F.split("path", "/")
    name = F.url_decode(F.replace(F.element_at(at, -1), F.lit("+"), F.lit("%2B")))
    category = F.url_decode(F.replace(F.element_at(at, -2), F.lit("+"), F.lit("%2B")))
    return files.select(category.alias("category"), name.alias("name"), decode(F.col("content")).alias("raw_text"))


def categories(articles: DataFrame) -> DataFrame:
    return articles.select("category").distinct().orderBy("category")


def category_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def head_per_category(articles: DataFrame, n: int | None, order: str = "name") -> DataFrame:
    """The first n articles of each category, before anything is filtered; none or 0 means all."""
    if not n:
        return articles
    rank = F.row_number().over(Window.partitionBy("category").orderBy(order))
    return articles.withColumn("head_rank", rank).where(F.col("head_rank") <= n).drop("head_rank")


def exact_dedup(docs: DataFrame, text: str = "text", order: tuple[str, ...] = ("category", "doc_id"), digest: Column | None = None) -> DataFrame:
    """One document for each text, the first in order, whole as it is; rows without a text are all one text.

    Each task reduces its rows to the first of each hash before they are shuffled, so a text that a third of the rows share is
    one row for each task by then.  Rows that tie in order are told apart by their other columns.  Rows without the text itself
    bring its ``digest``.
    """
    rest = [c for c in docs.columns if c not in order]
    first = docs.groupBy((F.md5(text) if digest is None else digest).alias("text_md5")).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*[F.col("first")[c].alias(c) for c in docs.columns])


def long_enough(docs: DataFrame, min_tokens: int = MIN_TOKENS, text: str = "text") -> DataFrame:
    """Rows of ``min_tokens`` tokens or more, with ``n_tokens``.

    The count is a generated column, which a filter is not pushed below, so it is evaluated once.
    """
    counted = docs.select("*", F.inline(F.array(F.struct(token_count(F.col(text)).alias("n_tokens")))))
    return counted.where(F.col("n_tokens") >= min_tokens)


def load_corpus(articles: DataFrame, min_tokens: int = MIN_TOKENS, max_docs_per_category: int | None = None) -> DataFrame:
    """Cleaned, long enough and distinct articles: doc_id, category, text, raw_text.

    Equal texts are equally long, so lengths are looked at after deduplication; articles are cleaned once.
    """
    rows = head_per_category(articles, max_docs_per_category)
    rows = rows.select(F.concat_ws("/", "category", "name").alias("doc_id"), "category", clean_article(F.col("raw_text")).alias("text"), "raw_text")
    return exact_dedup(rows).where(token_count(F.col("text")) >= min_tokens)


def sample_per_category(docs: DataFrame, names: list[str], n: int = 5) -> DataFrame:
    """The first n documents of each named category."""
    return head_per_category(docs.where(F.col("category").isin(names)), n, "doc_id")
