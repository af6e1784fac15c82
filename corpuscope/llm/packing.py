"""Sum-of-squares online packing of documents into token windows (operator 7).

Documents come one after another.  A document of a window or more fills whole windows with its
head; what is left goes where it keeps the squared counts of partially filled windows, summed over
fill levels, smallest.  A level array holds the number of open windows at each level of ``GRAIN`` tokens.  A window with less room than
that is at no level any more: it is closed by the head of the next document, cut where the window is full.  So few windows are open at a
time, and most are closed by placement.  When a
task's rows end, the open windows are emptied into one another by cutting pieces, so that each task
leaves one padded window at most.

A task packs its own rows, in the order in which it reads them, with a level array and the open windows' ids as
its only state.  Window numbers derive from the task's number, so a task that runs again after
a loss gives the same windows.  ``placed`` says whether a window was closed by placement or at the task's end.

Defined results: a null or empty text is the end mark alone; repeated rows are packed
each by itself; of windows that are equally good the fullest is taken; texts of any length are tokenized whole; an empty table gives no rows;
other columns are not kept, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm.common import slices, table
from corpuscope.llm.tokens import VOCABULARY, encoder

WINDOW, GRAIN = 4096, 128
END = np.array([2], "<u4").tobytes()
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = ", ".join(f"{c} long" for c in FIELDS) + ", placed boolean"
OUT_ROWS = 20_000


class SumOfSquares:
    """Packs (id, start, ids, doc_tokens) remainders; finished windows come out of ``place`` and ``close``."""

    def __init__(self, window: int = WINDOW, grain: int = 1) -> None:
        self.window, self.grain, self.top = window, grain, window // grain
        self.count = np.zeros(self.top + 1, np.int64)  # open windows at each level; a window's level is its fill in grains, rounded up
        self.fill = np.zeros(self.top + 1, np.int64)  # what the window holds that a level would give next
        self.open: list[list[tuple[int, list[tuple]]]] = [[] for _ in range(self.top + 1)]
        self.nearly: list[tuple[int, list[tuple]]] = []  # windows with less room than a grain

    def level_of(self, fill: int) -> int:
        return -(-fill // self.grain)

    def level_for(self, size: int) -> int:
        """The level of the window that takes a piece of this size; 0 opens a new one."""
        n = self.count
        levels = np.flatnonzero(n[1 : self.top]) + 1
        levels = levels[self.fill[levels] + size <= self.window]
        if not len(levels):
            return 0
        to = -(-(self.fill[levels] + size) // self.grain)
        change = np.where(to == self.top, 1 - 2 * n[levels], np.where(to == levels, 0, 2 * (n[to] - n[levels]) + 2))
        mine = self.level_of(size)
        new = 0 if mine == self.top else 2 * int(n[mine]) + 1
        best = len(levels) - 1 - int(change[::-1].argmin())  # of equal ones the fullest
        return int(levels[best]) if change[best] <= new else 0

    def _pop(self, level: int) -> tuple[int, list[tuple]]:
        held = self.open[level].pop()
        self.count[level] -= 1
        self.fill[level] = self.open[level][-1][0] if self.open[level] else 0
        return held

    def place(self, piece: tuple, size: int) -> list[tuple] | None:
        """Add a piece smaller than a window; the window's pieces if it is full now."""
        level = self.level_for(size)
        fill, held = self._pop(level) if level else (0, [])
        held.append(piece)
        fill += size
        if fill == self.window:
            return held
        level = self.level_of(fill)
        if level == self.top:
            self.nearly.append((fill, held))
        else:
            self.open[level].append((fill, held))
            self.count[level] += 1
            self.fill[level] = fill
        return None

    def close(self, doc: int, ids: bytes, total: int) -> tuple[int, list[tuple] | None]:
        """How many of a document's first ids a nearly full window takes, and its pieces if it is full now."""
        if not self.nearly:
            return 0, None
        fill, held = self.nearly.pop()
        n = min(self.window - fill, total)
        held.append((doc, 0, ids[: 4 * n], total))
        if fill + n == self.window:
            return n, held
        self.nearly.append((fill + n, held))
        return n, None

    def drain(self) -> Iterator[list[tuple]]:
        """The open windows, emptied into one another; all but the last are full."""
        windows = [held for _, held in self.nearly] + [held for level in reversed(self.open) for _, held in level]
        now, room = [], self.window
        for doc, start, ids, total in (p for held in windows for p in held):
            at = 0
            while at < len(ids):
                cut = ids[at : at + 4 * room]
                now.append((doc, start + at // 4, cut, total))
                at += len(cut)
                room -= len(cut) // 4
                if not room:
                    yield now
                    now, room = [], self.window
        if now:
            yield now


def pack_stream(docs: Iterator[tuple], window: int = WINDOW, grain: int = GRAIN) -> Iterator[tuple[list[tuple], bool]]:
    """Windows, as lists of (id, start, ids, doc_tokens), of a stream of (id, ids), and whether placement closed them."""
    packer = SumOfSquares(window, grain)
    for doc, ids in docs:
        total = len(ids) // 4
        at, full = packer.close(doc, ids, total)
        if full:
            yield full, True
        while total - at >= window:
            yield [(doc, at, ids[4 * at : 4 * (at + window)], total)], True
            at += window
        if total > at:
            full = packer.place((doc, at, ids[4 * at :], total), total - at)
            if full:
                yield full, True
    for held in packer.drain():
        yield held, False


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece of a document, with the window that holds it and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        number = TaskContext.get().partitionId() << 32
        stream = ((i, encode(t or "") + END) for b in slices(batches) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        rows: list[tuple] = []
        for held, placed in pack_stream(stream, window):
            offset = 0
            for doc, start, ids, total in held:
                rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, number, offset, placed))
                offset += len(ids) // 4
            number += 1
            if len(rows) >= OUT_ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    *numbers, placed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array(placed)], [*FIELDS, "placed"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
