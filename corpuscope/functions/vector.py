"""Vector arithmetic on array columns; sums are in double precision whatever the arrays hold."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(column: pa.Array, width: int | None = None, kind: type = np.float64) -> np.ndarray:
    """The rows of a list column, all of one length, as a matrix; no element becomes a Python object."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1 if width is None and len(flat) else width or 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times, also inside lambdas, but compute it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    """Plain dot product, the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    def scaled(v: Column) -> Column:
        return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))

    return let(a, scaled)


def argmax(a: Column) -> Column:
    """Position from 0 of the largest value, the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def top_positions(a: Column, k: int) -> Column:
    """The k largest values with their positions, largest first, lower positions first on ties."""
    ranked = F.array_sort(F.transform(a, lambda p, i: F.struct((-p).alias("n"), i.cast("int").alias("cluster"), p.alias("p"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: F.struct(s.cluster.alias("cluster"), s.p.alias("p")))


def entropy(u: Column) -> Column:
    """Entropy of memberships in nats; the small term keeps the logarithm finite."""
    return F.aggregate(u, F.lit(0.0), lambda s, p: s - p * F.log(p + 1e-10))
