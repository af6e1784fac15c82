"""Text to unit vectors.  The default needs no model: tokens are hashed to signed coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.text import tokens

DIMENSIONS = 384
BATCH = 64


class Encoder(Protocol):
    def __call__(self, text: Column) -> Column:
        """A unit vector for each text."""


class HashingEncoder:
    """Signed token counts by hash, scaled to unit length; a text without tokens gets zeros.

    Tokens are hashed in the JVM; a batch's hashes are counted at once, so the work grows with the tokens alone.
    """

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions

    def __call__(self, text: Column) -> Column:
        d = self.dimensions

        @F.pandas_udf("array<double>")
        def counted(hashes: pd.Series) -> pd.Series:
            n = np.fromiter((len(x) for x in hashes), np.int64, len(hashes))
            h = np.concatenate([np.zeros(0, np.int64), *hashes])
            at = np.repeat(np.arange(len(n)), n) * d + h % d
            v = np.bincount(at, np.where(h < 0, -1.0, 1.0), minlength=len(n) * d).reshape(-1, d)
            return pd.Series(list(v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)))

        return counted(F.transform(tokens(F.lower(text)), lambda t: F.xxhash64(t)))


_models: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """The model of a name, made by the first task of a worker process and kept for those after it."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


class ModelEncoder:
    """A sentence model, made once in each worker by ``load``; its ``encode`` gets lists of texts.

    Encoders with one ``name`` share the model; by default it is that of the function.
    """

    def __init__(self, load: Callable[[], object], batch: int = BATCH, name: str | None = None) -> None:
        self.load, self.batch, self.name = load, batch, name or f"{load.__module__}.{load.__qualname__}"

    def __call__(self, text: Column) -> Column:
        load, batch, name = self.load, self.batch, self.name

        @F.pandas_udf("array<double>")
        def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from corpuscope.operators.encoder import loaded

            model = loaded(name, load)
            for s in parts:
                out: list[np.ndarray] = []
                for i in range(0, len(s), batch):
                    v = np.asarray(model.encode(s.iloc[i : i + batch].fillna("").tolist()), np.float64)
                    out += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
                yield pd.Series(out)

        return encode(text)


def embed(docs: DataFrame, encoder: Encoder | None = None, text_col: str = "text", out: str = "embedding") -> DataFrame:
    return docs.withColumn(out, (encoder or HashingEncoder())(F.col(text_col)))
