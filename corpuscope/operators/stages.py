"""Reduction and soft clustering as stages of Spark's own pipelines: fitted, saved, loaded and swept like any other stage.

Vectors are array columns.  A model's arrays are written beside its parameters, with Spark's own writers.
"""

from __future__ import annotations

from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasMaxIter, HasOutputCol, HasSeed, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.vector import argmax
from corpuscope.operators.fcm import FUZZINESS, MAX_ITER, N_CLUSTERS, SEED, TOLERANCE, FuzzyCMeans
from corpuscope.operators.pca import DIMENSIONS, CenteredPCA
from corpuscope.operators.quality import linear_silhouettes
from corpuscope.shared import passing, written


class _ArraysWriter(MLWriter):
    """Parameters as Spark writes them, and the model's arrays in a folder beside them."""

    def __init__(self, model: Any) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.save(self.sparkSession, f"{path}/arrays")


class _ArraysReader(MLReader):
    def __init__(self, kind: type) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Any:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(self.kind.arrays.load(self.sparkSession, f"{path}/arrays"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class _ArraysModel(Model, MLWritable, MLReadable):
    """A model around something with ``save`` and ``load``."""

    arrays: type

    def __init__(self, fitted: Any = None) -> None:
        super().__init__()
        self.fitted = fitted

    def write(self) -> MLWriter:
        return _ArraysWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ArraysReader(cls)


class _ReductionParams(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "components that are kept, cut to the dimensions there are", TypeConverters.toInt)

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self._setDefault(inputCol="vec", outputCol="reduced", k=DIMENSIONS)


class ReductionModel(_ArraysModel, _ReductionParams):
    arrays = CenteredPCA

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getInputCol(), self.getOutputCol())


class Reduction(Estimator, _ReductionParams, DefaultParamsWritable, DefaultParamsReadable):
    """Centered principal components."""

    @keyword_only
    def __init__(self, *, inputCol: str = "vec", outputCol: str = "reduced", k: int = DIMENSIONS) -> None:  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ReductionModel:
        return self._copyValues(ReductionModel(CenteredPCA(self.getOrDefault("k")).fit(dataset, self.getInputCol())))


class _ClusterParams(HasInputCol, HasOutputCol, HasMaxIter, HasTol, HasSeed):
    k = Param(Params._dummy(), "k", "clusters", TypeConverters.toInt)
    m = Param(Params._dummy(), "m", "fuzziness, above 1", TypeConverters.toFloat)
    kind = Param(Params._dummy(), "kind", "'squared', or 'standard' for the textbook's exponent", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "ids from whose hashes the start is drawn", TypeConverters.toString)
    startCol = Param(Params._dummy(), "startCol", "starting memberships; empty for drawn ones", TypeConverters.toString)

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self._setDefault(inputCol="reduced", outputCol="memberships", k=N_CLUSTERS, m=FUZZINESS, kind="squared", idCol="id", startCol="", maxIter=MAX_ITER, tol=TOLERANCE, seed=SEED)


class SoftClustersModel(_ArraysModel, _ClusterParams):
    arrays = FuzzyCMeans

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        found = self.fitted.transform(dataset.drop("memberships"), self.getInputCol())
        return found if out == "memberships" else found.withColumnRenamed("memberships", out)


class SoftClusters(Estimator, _ClusterParams, DefaultParamsWritable, DefaultParamsReadable):
    """Fuzzy C-Means; the rows are written once, and every iteration reads them from there."""

    @keyword_only
    def __init__(
        self, *, inputCol: str = "reduced", outputCol: str = "memberships", k: int = N_CLUSTERS, m: float = FUZZINESS, kind: str = "squared", idCol: str = "id", startCol: str = "",  # noqa: N803
        maxIter: int = MAX_ITER, tol: float = TOLERANCE, seed: int = SEED,  # noqa: N803
    ) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> SoftClustersModel:
        start, get = self.getOrDefault("startCol"), self.getOrDefault
        with passing(dataset.sparkSession):
            rows = dataset.select(F.col(get("idCol")).alias("id"), F.col(self.getInputCol()).alias("vec"), *([F.col(start).alias("memberships")] if start else []))
            fitted = FuzzyCMeans(k=get("k"), m=get("m"), max_iter=self.getMaxIter(), tol=self.getTol(), seed=self.getSeed(), kind=get("kind")).fit(written(rows, "fcm-fit"))
        return self._copyValues(SoftClustersModel(fitted))


class LinearSilhouette(Evaluator):
    """The mean silhouette of hard labels in squared distance, over all rows, for sweeps over parameters."""

    def __init__(self, vec_col: str = "vec", memberships_col: str = "memberships", id_col: str = "id") -> None:
        super().__init__()
        self.columns = (id_col, vec_col, memberships_col)

    def _evaluate(self, dataset: DataFrame) -> float:
        i, vec, u = self.columns
        rows = dataset.select(F.col(i).alias("id"), F.col(vec).alias("vec"), argmax(F.col(u)).alias("cluster"))
        return float(linear_silhouettes(rows).agg(F.avg("silhouette")).first()[0] or 0.0)


def sweep(spark: SparkSession, rows: DataFrame, stages: list[Estimator], grid: list[dict], score: Evaluator) -> list[tuple[dict, float]]:
    """Each point of a grid (by name) with its score, the best first and earlier ones first on ties; stages before the last are fitted once."""
    with passing(spark):
        for stage in stages[:-1]:
            rows = written(stage.fit(rows).transform(rows), "sweep")
        made = [({p.name: v for p, v in point.items()}, score.evaluate(stages[-1].fit(rows, point).transform(rows))) for point in grid]
    return sorted(made, key=lambda x: -x[1])
