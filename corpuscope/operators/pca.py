"""Centered principal components; the mean is kept and subtracted, which Spark's own model does not do."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.vector import matrix

DIMENSIONS = 50


@dataclass
class CenteredPCA:
    k: int = DIMENSIONS
    mean: np.ndarray | None = None
    components: np.ndarray | None = None  # d x k
    explained: np.ndarray | None = None

    def fit(self, rows: DataFrame, vec_col: str = "vec") -> CenteredPCA:
        """From all rows; more components than dimensions are cut to the dimensions."""
        vectors = rows.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("v"))
        self.mean = np.array(vectors.select(Summarizer.mean(F.col("v"))).first()[0].toArray())
        model = PCA(k=min(self.k, len(self.mean)), inputCol="v", outputCol="p").fit(vectors)
        self.components, self.explained = model.pc.toArray(), model.explainedVariance.toArray()
        return self

    def transform(self, rows: DataFrame, vec_col: str = "vec", out: str = "reduced") -> DataFrame:
        """The rows with their centered projection."""
        shared = rows.sparkSession.sparkContext.broadcast((self.mean, self.components))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mean, components = shared.value
            for b in batches:
                if b.num_rows:
                    x = (matrix(b.column(vec_col), len(mean)) - mean) @ components
                    flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), np.ascontiguousarray(x).ravel())
                    yield pa.RecordBatch.from_arrays([*b.columns, flat], [*b.schema.names, out])

        return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("mean", 0, self.mean.tolist()), ("explained", 0, self.explained.tolist()), *(("component", i, c.tolist()) for i, c in enumerate(self.components.T))]
        spark.createDataFrame(rows, "part string, i int, value array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> CenteredPCA:
        rows = spark.read.parquet(path).orderBy("part", "i").collect()  # k + 2 rows
        by = {p: [np.array(r.value) for r in rows if r.part == p] for p in ("mean", "explained", "component")}
        return CenteredPCA(len(by["component"]), by["mean"][0], np.stack(by["component"], axis=1), by["explained"][0])

