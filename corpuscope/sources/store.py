"""The vector table: create, append, count, scan, update, reset.

Writers take a mode instead of asking.  Updates write a new version beside the old one, and appends write a part of their own
beside the version they add to.  The latest version that was written to its end counts, with those of its parts that were; so readers never
see half an update or half an append, and one that fails changes nothing.
"""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.shared import drop_path

SCHEMA = (
    "doc_id string, embedding array<float>, text string, category string, dominant_cluster int, "
    "cluster_probs array<struct<cluster:int,p:double>>"
)
#: A version, or a part that was appended to one.
FOLDER = re.compile(r"v\d{8}(-[0-9a-f]{32})?")


def rendered_metadata(df: DataFrame) -> DataFrame:
    """Scalars as they are, everything else as JSON text."""
    simple = ("string", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean")
    return df.select(*[F.col(c) if t in simple else F.to_json(c).alias(c) for c, t in df.dtypes])


class VectorStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self) -> dict[int, list[str]]:
        """Folders that were written to their end, by version: the version itself and what was appended to it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        if not self._fs.exists(path(self.path)):
            return {}
        names = sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(path(self.path))) if FOLDER.fullmatch(n))
        found: dict[int, list[str]] = {}
        for n in names:
            if self._fs.exists(path(f"{self.path}/{n}/_SUCCESS")):
                found.setdefault(int(n[1:9]), []).append(n)
        return {v: folders for v, folders in found.items() if "-" not in folders[0]}

    def _next(self) -> str:
        return f"{self.path}/v{max(self._whole(), default=0) + 1:08d}"

    def frame(self) -> DataFrame:
        """All rows of the current version; none if nothing was written."""
        found = self._whole()
        folders = [f"{self.path}/{n}" for n in found[max(found)]] if found else []
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def count(self) -> int:
        return self.frame().count()

    def add(self, docs: DataFrame, mode: str = "append") -> None:
        """Append to the current version, ``overwrite`` it, or do nothing (``ignore``) or fail (``errorifexists``) if there are rows."""
        found = self._whole()
        if found and mode in ("ignore", "errorifexists"):
            if mode == "errorifexists":
                raise ValueError(f"{self.path} holds rows already")
            return
        names = [f.name for f in self.spark.createDataFrame([], SCHEMA).schema]
        kinds = dict(self.spark.createDataFrame([], SCHEMA).dtypes)
        rows = docs.select(*[(F.col(n) if n in docs.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
        if found and mode == "append":
            rows.write.parquet(f"{self.path}/v{max(found):08d}-{uuid4().hex}")
        else:
            rows.write.mode("overwrite").parquet(self._next())

    def update(self, changes: DataFrame) -> None:
        """Set the columns of ``changes`` (keyed by doc_id) in a new version; other columns and rows stay.

        Of several changes to one id the smallest counts, so rows are never multiplied.
        """
        now = self.frame()
        rest = [c for c in changes.columns if c != "doc_id"]
        changes = changes.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("first")).select("doc_id", "first.*")
        new = [c for c in changes.columns if c != "doc_id"]
        joined = now.join(changes.select("doc_id", F.lit(True).alias("changed"), *[F.col(c).alias(f"new_{c}") for c in new]), "doc_id", "left")
        rows = joined.select(*[F.when(F.col("changed"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in now.columns])
        rows.write.mode("overwrite").parquet(self._next())

    def reset(self) -> None:
        drop_path(self.spark, self.path)
