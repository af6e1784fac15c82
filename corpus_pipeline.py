"""A training corpus from raw documents: five stages, each of them one operator of ``corpuscope.llm``.

Every stage takes the rows that its predecessor kept and gives its result as a frame; ``run`` writes
each result to the shared folder and reads it again, so a lost executor costs one stage's tasks at most, and deletes what a
stage and its predecessor wrote on the way once its result is there.

Stages treat nulls, empty and very long texts, ties, repeated rows and empty tables as their operators say; columns beyond those of
documents are not kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import language, mixing, neardup, packing, toxicity
from corpuscope.shared import drop_path, new_path, passing, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus.

    Texts without a letter go, and texts with many letters that resemble no language's profile.
    """
    rows = language.predict(docs, language.learn(docs), keep=COLUMNS)
    return rows.where(~language.rejected()).select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, scores below the threshold."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).where(toxicity.predicted() == 0).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8 or more) one row, of the smallest id.

    That is one row of each component; where its smallest id has several texts in it, the one with the smallest hash.  Texts without
    words are no one's duplicates but those of their own id and text.  Rows without an id all stay.
    """
    found = neardup.near_duplicates(docs.select("doc_id", "text"), width=5, share=(80, 100)).where("kept AND doc_id IS NOT NULL")
    own_text = F.when(F.col("n_shingles") == 0, F.col("key"))
    stay = found.groupBy("component_id", own_text.alias("own_text")).agg(F.min("key").alias("key")).select(F.col("component_id").alias("doc_id"), "key")
    rows = docs.select(*COLUMNS).withColumn("key", F.xxhash64("text")).join(stay.hint("merge"), ["doc_id", "key"])
    # rows that repeat with id and text are one, the first in order of the other columns
    first = rows.groupBy("doc_id", "key").agg(F.min(F.struct("source", "lang", "n_chars", "text")).alias("row"))
    return first.select("doc_id", *[F.col("row")[c].alias(c) for c in COLUMNS[1:]]).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in the proportions of the mix, shuffled within its shards; a row for each copy.

    Shards have about as many bytes each, however many documents there are.
    """
    mix = mixing.mixed(docs.select(*COLUMNS), mixing.plan(docs, shards=None))
    return mix.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token windows: a row for each piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("language", in_known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed_to_weights),
    ("packing", packed),
]

#: Models, minwise trees and tokenizers have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = ""
    for name, stage in STAGES:
        before, path = path, new_path(spark, f"stage-{name}")
        with passing(spark):  # what the stage writes on the way
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", path)
        if before:
            drop_path(spark, before)
    return docs
