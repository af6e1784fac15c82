"""Sharding by fixed virtual slots (operator 6).

A record's id decides, once and for all, in which of some thousands of virtual slots it lies.
Shards own slots through a small map that is stored with a version number.  Bytes are summed per
slot, and rebalancing edits the map: it moves single slots, never rehashes records.  The map has as
many rows as there are slots, a parameter, so it may be collected, edited on the driver and
broadcast whatever the size of the data.

A record's place in its shard counts the rows before it.  Slots are ordered by tasks of their own; a slot of more than
``RANK_ROWS`` rows, such as one that holds a repeated id, is split by a salt that is written with the records.

Defined results: a null text has no bytes; rows without an id are dealt by their text; repeated
rows share a slot, so one that holds a large part of all bytes is more than a shard's share; texts of any length are
measured whole; an empty table gives an empty result and an unedited map; other columns of the
input are neither read nor kept, so their names cannot clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.llm.common import table, utf8
from corpuscope.shared import new_path, written

N_SLOTS = 4096
N_SHARDS = 16
#: Rows of a slot that one task ranks.
RANK_ROWS = 1_000_000
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    """One version of the map from slots to shards, with what each slot held when it was made."""

    version: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]
    rows: tuple[int, ...]

    @staticmethod
    def initial(n_slots: int = N_SLOTS, n_shards: int = N_SHARDS) -> SlotMap:
        return SlotMap(0, tuple(s % n_shards for s in range(n_slots)), (0,) * n_slots, (0,) * n_slots)

    def measured(self, per_slot: dict[int, tuple[int, int]]) -> SlotMap:
        """The same assignment with new sizes: slot to (bytes, rows)."""
        got = [per_slot.get(s, (0, 0)) for s in range(len(self.shard))]
        return replace(self, bytes=tuple(b for b, _ in got), rows=tuple(r for _, r in got))

    def loads(self, n_shards: int) -> list[int]:
        out = [0] * n_shards
        for s, b in zip(self.shard, self.bytes, strict=True):
            out[s] += b
        return out

    def rebalanced(self, n_shards: int = N_SHARDS) -> SlotMap:
        """The next version: single slots go from the fullest to the emptiest shard while that helps.

        Each edit takes the slot whose bytes come nearest to half of the difference, so the spread
        falls with every edit and ends below the smallest slot that could still be moved.  A second
        phase swaps a pair of slots between the two shards where no single move helps.
        """
        shard, load = list(self.shard), self.loads(n_shards)
        owned: list[set[int]] = [set() for _ in range(n_shards)]
        for s, to in enumerate(shard):
            owned[to].add(s)

        def give(s: int, a: int, b: int) -> None:
            owned[a].discard(s)
            owned[b].add(s)
            shard[s] = b
            load[a] -= self.bytes[s]
            load[b] += self.bytes[s]

        for _ in range(4 * len(shard)):
            a, b = max(range(n_shards), key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
            gap = load[a] - load[b]
            moves = [(abs(gap - 2 * self.bytes[s]), s) for s in owned[a] if 0 < self.bytes[s] < gap]
            best = min(moves, default=(gap, -1))
            if best[1] >= 0 and best[0] < gap // 2:
                give(best[1], a, b)
                continue
            mine, theirs = sorted((self.bytes[s], s) for s in owned[a]), sorted((self.bytes[s], s) for s in owned[b])
            swap, j = (gap, -1, -1), 0
            for x, s in mine:  # the partner that brings the two loads nearest to each other
                while j + 1 < len(theirs) and x - theirs[j + 1][0] >= gap / 2:
                    j += 1
                for y, t in theirs[j : j + 2]:
                    swap = min(swap, (abs(gap - 2 * (x - y)), s, t))
            if swap[1] >= 0 and swap[0] < min(gap, best[0]) and swap[0] < gap - gap // 64:
                give(swap[1], a, b)
                give(swap[2], b, a)
            elif best[1] >= 0 and best[0] < gap:
                give(best[1], a, b)
            else:
                break
        return replace(self, version=self.version + 1, shard=tuple(shard))

    def grown(self, n_shards: int) -> SlotMap:
        """The next version with one shard more, which takes an equal share of slots; no other shard gains."""
        shard, want = list(self.shard), len(self.shard) // (n_shards + 1)
        owned: list[list[int]] = [[] for _ in range(n_shards)]
        for s, to in enumerate(shard):
            owned[to].append(s)
        heap = [(-len(x), i) for i, x in enumerate(owned)]
        heapq.heapify(heap)
        for _ in range(want):
            n, i = heapq.heappop(heap)
            shard[owned[i].pop()] = n_shards
            heapq.heappush(heap, (n + 1, i))
        return replace(self, version=self.version + 1, shard=tuple(shard))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, s, *x) for s, x in enumerate(zip(self.shard, self.bytes, self.rows, strict=True))]
        return spark.createDataFrame(rows, MAP_SCHEMA)


def save_map(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Add a version to a stored map; earlier versions stay readable."""
    m.frame(spark).coalesce(1).drop("version").write.mode("error").parquet(f"{path}/version={m.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the latest by default; as many rows as slots."""
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    at = version if version is not None else every.agg(F.max("version")).first()[0]
    rows = every.where(F.col("version") == at).orderBy("vslot").collect()
    return SlotMap(at, tuple(r.shard for r in rows), tuple(r.bytes for r in rows), tuple(r.rows for r in rows))


def virtual_slot(id_col: Column, text_col: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record: a hash of its id, or of its text where there is no id."""
    key = F.xxhash64(F.coalesce(id_col.cast("string"), F.concat(F.lit("\0"), F.coalesce(text_col, F.lit("")))))
    return F.pmod(key, F.lit(n_slots)).cast("int")


def records(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow view that sharding needs: id, size, checksum, slot and a salt, without the text.  To be written before it is used twice."""
    body = utf8(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        virtual_slot(F.col(id_col), F.col(text_col), n_slots).alias("vslot"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )


def per_slot(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot; at most as many entries as there are slots."""
    got = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r.vslot: (r.bytes, r.n) for r in got}


def placed(rows: DataFrame, m: SlotMap) -> DataFrame:
    """Each record with its shard and its place in the shard, without gaps from 0.

    The place is the number of rows in the shard's earlier slots, and in the earlier parts of its own slot, plus the row's rank in its
    part, so that no window spans more than one part of a slot.  There are as many parts as slots and one more for each
    ``RANK_ROWS`` rows at most.
    """
    spark = rows.sparkSession
    parts_of = spark.createDataFrame([(s, -(-n // RANK_ROWS)) for s, n in enumerate(m.rows) if n > RANK_ROWS], "vslot int, parts int")
    rows = rows.join(F.broadcast(parts_of), "vslot", "left").withColumn("part", F.coalesce(F.pmod("salt", "parts"), F.lit(0)).cast("int")).drop("parts", "salt")
    sizes: dict[int, list[int]] = {s: [n] for s, n in enumerate(m.rows)}
    if any(n > RANK_ROWS for n in m.rows):
        for s in sizes:
            sizes[s] = [0] * max(1, -(-m.rows[s] // RANK_ROWS))
        for r in rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r.vslot][r.part] = r.n
    before: dict[int, int] = {}
    offsets = []
    for s, to in enumerate(m.shard):
        for part, n in enumerate(sizes[s]):
            offsets.append((s, part, to, before.get(to, 0), m.bytes[s]))
            before[to] = before.get(to, 0) + n
    of = spark.createDataFrame(offsets, "vslot int, part int, shard int, first long, slot_bytes long")
    rank = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("in_slot", rank)
        .join(F.broadcast(of), ["vslot", "part"])  # a row for each part of a slot
        .withColumn("slot", F.col("first") + F.col("in_slot") - 1)
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, by the stored map's second version."""
    rows = written(records(table(spark, sf_dir, "documents")), "shard-records")
    path = new_path(spark, "slot-map")
    first = SlotMap.initial().measured(per_slot(rows))
    save_map(spark, first, path)
    save_map(spark, first.rebalanced(), path)
    m = load_map(spark, path)
    return placed(rows, m).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"), "slot_bytes", F.lit(m.version).alias("map_version"),
    )


QUERIES = {"op6_sharding": op6_sharding}
ORACLE_SQL: dict[str, str] = {}
