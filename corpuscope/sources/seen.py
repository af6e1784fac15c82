"""Exact deduplication across ingests: the hashes of every text that was ever kept, in a bucketed table.

A batch is reduced to the first of each text, and what the table has of earlier batches is taken out by an anti join.  The table is stored in
buckets of the hash, so the join shuffles the batch alone, however large the table has grown.  Each batch has a partition of its own: one that
runs again replaces what it wrote, and sees what earlier ones wrote and no more.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.sources.corpus import exact_dedup

BUCKETS = 64


class SeenTexts:
    """The table ``name`` in a folder; a session that does not know it yet registers it from there."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            spark.sql(f"CREATE TABLE {name} (text_md5 STRING, batch BIGINT) USING parquet OPTIONS (path '{path}') PARTITIONED BY (batch) CLUSTERED BY (text_md5) SORTED BY (text_md5) INTO {buckets} BUCKETS")
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                spark.sql(f"MSCK REPAIR TABLE {name}")

    def hashes(self, before: int | None = None) -> DataFrame:
        """(text_md5) of all batches, or of those with smaller numbers."""
        rows = self.spark.table(self.name)
        return (rows if before is None else rows.where(F.col("batch") < before)).select("text_md5")

    def fresh(self, docs: DataFrame, batch: int, text: str = "text", order: tuple[str, ...] = ("category", "doc_id"), digest: Column | None = None) -> DataFrame:
        """The first document of each text that no earlier batch kept."""
        digest = F.md5(text) if digest is None else digest
        first = exact_dedup(docs, text, order, digest)
        return first.withColumn("text_md5", digest).join(self.hashes(batch), "text_md5", "left_anti").select(*docs.columns)

    def add(self, kept: DataFrame, batch: int, text: str = "text", digest: Column | None = None) -> None:
        """Remember the texts that a batch kept."""
        rows = kept.select((F.md5(text) if digest is None else digest).alias("text_md5")).distinct().repartition(self.buckets, "text_md5")
        view = f"kept_{uuid4().hex}"
        rows.createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = {int(batch)}) SELECT text_md5 FROM {view}")
        self.spark.catalog.dropTempView(view)

    def drop(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
