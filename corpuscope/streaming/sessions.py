"""Sessions as a stream: each has a semantic cache of its own, whose entries lie in Spark's state store.

A session's queries are answered in order, so an answer depends on the queries before it, in whichever batch they came.  What
a session has stored is list state, keyed by the session; a batch reads it once for each session it touches, scores the batch's queries against it and
adds the new entries.  The state survives restarts with the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuscope.operators.cache import SECONDARY, THRESHOLD, indexed, probed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Entries for which a session's matrix first has room.
ROOM = 64


class Entries:
    """What a session has stored: rows of a matrix that doubles when it is full, so adding a row copies nothing on average."""

    def __init__(self) -> None:
        self.n, self.vecs, self.flags = 0, np.zeros((0, 0)), np.zeros((0, 0), bool)

    def add(self, vec: np.ndarray, flags: np.ndarray) -> None:
        if self.n == len(self.vecs):
            room = max(ROOM, 2 * self.n)
            vecs, marks = np.zeros((room, len(vec))), np.zeros((room, len(flags)), bool)
            if self.n:
                vecs[: self.n], marks[: self.n] = self.vecs, self.flags
            self.vecs, self.flags = vecs, marks
        self.vecs[self.n], self.flags[self.n] = vec, flags
        self.n += 1

    def answer(self, vec: np.ndarray, probe: np.ndarray, flags: np.ndarray, threshold: float) -> tuple[bool, int | None, float | None]:
        """(hit, entry, score) of a query, which becomes an entry if it misses; the earliest entry of equal ones is the hit."""
        if self.n:
            met = (self.flags[: self.n] & probe).any(axis=1)
            score = np.where(met, self.vecs[: self.n] @ vec, -np.inf)
            at = int(score.argmax())
            if score[at] >= threshold and score[at] > -1.0:
                return True, at, float(score[at])
        self.add(vec, flags)
        return False, None, None


class SessionCache(StatefulProcessor):
    """Answers the queries of one session after another; its state is the session's entries in order."""

    def __init__(self, threshold: float, key: str) -> None:
        self.threshold, self.key = threshold, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("entries", "vec array<double>, flags array<boolean>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known, asked = Entries(), pd.concat(list(rows)).sort_values("query_id", kind="stable")  # a session's queries in one batch
        for vec, flags in self.state.get():
            known.add(np.asarray(vec, np.float64), np.asarray(flags, bool))
        out, first = [], known.n
        for i, vec, probe, flags in zip(asked["query_id"], asked["vec"], asked["probe"], asked["flags"], strict=True):
            out.append((key[0], i, *known.answer(np.asarray(vec, np.float64), np.asarray(probe, bool), np.asarray(flags, bool), self.threshold)))
        if known.n > first:
            self.state.appendList([(known.vecs[k].tolist(), known.flags[k].tolist()) for k in range(first, known.n)])
        made = pd.DataFrame(out, columns=[self.key, "query_id", "hit", "entry_idx", "score"])
        yield made.astype({"entry_idx": "Int64", "score": "float64"})

    def close(self) -> None:
        pass


def stream_sessions(queries: DataFrame, threshold: float = THRESHOLD, secondary: float = SECONDARY, session: str = "session") -> DataFrame:
    """A stream of (session, query_id, hit, entry_idx, score) from one of (session, query_id, vec, memberships).

    Queries of a session are answered in query_id order within a batch, and batch after batch; the session must keep state in RocksDB (``kept_in_rocks_db``).
    """
    rows = queries.select(session, "query_id", "vec", probed(F.col("memberships"), secondary).alias("probe"), indexed(F.col("memberships"), secondary).alias("flags"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{session}` {kind[session]}, query_id {kind['query_id']}, hit boolean, entry_idx long, score double"
    return rows.groupBy(session).transformWithStateInPandas(SessionCache(threshold, session), schema, "Append", "None")


@contextmanager
def kept_in_rocks_db(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which list state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def answered(queries: DataFrame, out: str, checkpoint: str, threshold: float = THRESHOLD, secondary: float = SECONDARY, session: str = "session") -> DataFrame:
    """Run the stream over all that has come so far and read what it answered, from this run and earlier ones.

    Answers are written by batch number, so a batch that runs again after a failure replaces its own.
    """
    spark = queries.sparkSession
    made = stream_sessions(queries, threshold, secondary, session)
    with kept_in_rocks_db(spark):
        run = made.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        run.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(out).select(*made.columns)
