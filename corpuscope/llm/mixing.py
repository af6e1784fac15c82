"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree (operator 9).

Each source's rows are dealt by hash into permuted blocks.  The target of a source, in words, fixes
how many whole passes over its blocks the mix takes and how many blocks of one more pass; the last
block is taken up to the row, and the row up to the word, where the target is met.  These draws are
an exact quota of blocks for each source.  A tree over the output shards splits the vector of quotas
in two by a multivariate hypergeometric draw until each shard has its own quotas; shards then take
disjoint ranges of every source's permuted blocks and shuffle their rows locally.

What is decided for each source (a row of the plan) goes to all executors; the rows themselves are
never shuffled to decide what is taken of them.  Blocks are summed before they are ordered, at most ``MAX_BLOCKS`` of a
source.  The block in which a source's target falls is cut again by the next bits of the rows' hashes, into ``1 <<
STEP_BITS`` parts that are summed before they are ordered, until ``CUT_ROWS`` rows at most are left, which are ordered by row; so no task
orders more than that, whatever the size of a source.  The number of sources is checked against ``MAX_SOURCES``.

Defined results: null texts have no words; rows of a null source are a source of their own, the last; a source
without words has target 0; rows that repeat with id and text share what falls on them equally,
rounded down; texts of any length are counted whole; an empty table gives an empty mix.  Extra columns go along in
``mixed`` whatever their names, but for ``shard``, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, gcd

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.llm.common import WORD_GAP, table, word_count
from corpuscope.shared import written

WEIGHTS = (3.0, 1.0, 2.0)
#: The mix has so many words for each word of the input, and takes no row more often than that.
BUDGET, MOST_PASSES = 1.5, 2
SHARDS = 16
SEED = 42
BLOCK_ROWS, MAX_BLOCKS, MAX_SOURCES = 32, 4096, 100_000
#: Rows of a source that one task orders, and the bits of a hash that a further cut looks at.
CUT_ROWS, STEP_BITS = 4096, 12
#: What a shard of the mix holds where no number of shards is given, and how many numbers a plan may hold.
SHARD_BYTES, MAX_SHARDS, MAX_QUOTAS = 8 << 20, 65_536, 1 << 24

PLAN_SCHEMA = (
    "source string, source_size long, target double, blocks long, factor long, shift long, passes long, "
    "last_rank long, cut_hash long, cut_key string, cut_words long, quota array<long>"
)
DRAW = "array<struct<pass:int,words:long,shard:int,key:long>>"


@dataclass
class Source:
    """A source's row of the plan."""

    name: str | None
    size: int
    rows: int
    target: float = 0.0

    def __post_init__(self) -> None:
        self.blocks = max(1, min(MAX_BLOCKS, ceil(self.rows / BLOCK_ROWS)))
        rng = np.random.default_rng([SEED, *(self.name or "\0").encode()])
        self.shift = int(rng.integers(self.blocks))
        self.factor = next(f for f in rng.integers(1, self.blocks + 1, 4096).tolist() + [1] if gcd(f, self.blocks) == 1)

    @property
    def words(self) -> int:
        return floor(self.target + 0.5)

    @property
    def passes(self) -> int:
        return min(MOST_PASSES, self.words // self.size) if self.size else 0

    @property
    def rest(self) -> int:
        return self.words - self.passes * self.size if self.size else 0


def targets(sizes: list[int], weights: list[float], budget: float, most: float = MOST_PASSES) -> list[float]:
    """Shares of the budget by weight; none above ``most`` times its size, the excess shared again by weight."""
    out, active = [0.0] * len(sizes), list(range(len(sizes)))
    while active:
        whole = sum(weights[k] for k in active)
        share = {k: budget * weights[k] / whole for k in active}
        over = [k for k in active if share[k] > most * sizes[k]]
        for k in over or active:
            out[k] = float(most * sizes[k]) if over else share[k]
        if not over:
            break
        budget -= sum(most * sizes[k] for k in over)
        active = [k for k in active if share[k] <= most * sizes[k]]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) in each shard (rows), by the splitting tree.

    Shards hold the same number of blocks, give or take one.  A node's generator is seeded by its range of
    shards, so every subtree can be drawn again by itself.
    """
    whole = int(quotas.sum())
    room = [whole // shards + (j < whole % shards) for j in range(shards)]
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(held, sum(room[lo:mid]), method="marginals")
        split(lo, mid, left)
        split(mid, hi, held - left)

    if len(quotas):
        split(0, shards, quotas.astype(np.int64))
    return out


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The hash that orders rows, and what tells rows of one hash apart."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    own = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.crc32(body.cast("binary")).cast("string"))
    return F.xxhash64(F.lit(SEED), own), own


def _rank(h: Column) -> Column:
    """The place of a row's block in its source's permutation."""
    return F.pmod(F.pmod(h, F.col("blocks")) * F.col("factor") + F.col("shift"), F.col("blocks"))


def _narrowed(ranked: DataFrame, end: dict) -> dict:
    """Where each source's last pass ends: ``end`` has (rank, left, rows) by source; adds the range ``lo`` .. ``hi`` of hashes and updates ``left``."""
    spark, state = ranked.sparkSession, {s: (r.rank, r.left, r.rows, 0, 0) for s, r in end.items()}
    schema = "end_source string, end_rank long, left long, bits int, prefix long"
    order = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 1)  # 63 bits in the order of the hashes
    while wide := {s: x for s, x in state.items() if x[2] > CUT_ROWS and x[3] + STEP_BITS <= 60}:
        bits = next(iter(wide.values()))[3]
        last = spark.createDataFrame([(s, x[0], x[1], x[3], x[4]) for s, x in wide.items() if x[3] == bits], schema)
        here = (F.col("source").eqNullSafe(F.col("end_source"))) & (F.col("rank") == F.col("end_rank")) & (F.shiftright(order, 63 - bits) == F.col("prefix") if bits else F.lit(True))
        inside = ranked.join(F.broadcast(last), here)  # a row for each source
        parts = inside.groupBy("source", "left", F.shiftright(order, 63 - bits - STEP_BITS).alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        parts = parts.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("part")))  # 1 << STEP_BITS rows of a source
        for r in parts.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left"))).collect():
            state[r.source] = (state[r.source][0], r.left - r.upto + r.size, r.rows, bits + STEP_BITS, r.part)
    return state


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, shards: int | None = SHARDS) -> DataFrame:
    """A row for each source: its target, its passes, where its last pass ends, and its shards' block quotas.

    Without a number of shards there are as many as make ``SHARD_BYTES`` each, within what a plan may hold.
    """
    spark = docs.sparkSession
    h, own = _key(id_col, text_col)
    body = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = written(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h"), own.alias("own"), body.alias("bytes")), "mix-rows")
    stats = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if shards is None:
        shards = max(1, min(MAX_SHARDS, MAX_QUOTAS // max(1, len(stats)), ceil(BUDGET * sum(r.bytes for r in stats) / SHARD_BYTES)))
    sources = [Source(r.source, r.size, r.rows) for r in sorted(stats, key=lambda r: (r.source is None, r.source or ""))]
    found = targets([s.size for s in sources], [weights[k % len(weights)] for k in range(len(sources))], BUDGET * sum(s.size for s in sources))
    for s, t in zip(sources, found, strict=True):
        s.target = t
    first = spark.createDataFrame([(s.name, s.blocks, s.factor, s.shift, s.rest) for s in sources], "name string, blocks long, factor long, shift long, rest long")
    ranked = rows.join(F.broadcast(first), F.col("source").eqNullSafe(F.col("name"))).withColumn("rank", _rank(F.col("h")))
    # where the last pass ends: first the block, from the blocks' sums, then a range of hashes in it, then the row
    order = Window.partitionBy("source").orderBy("rank")
    blocks = ranked.groupBy("source", "rest", "rank").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).withColumn("upto", F.sum("size").over(order))
    ends = blocks.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("size") < F.col("rest"))).select("source", "rank", (F.col("rest") - F.col("upto") + F.col("size")).alias("left"), "rows").collect()
    end = {r.source: r for r in ends}
    state = _narrowed(ranked, end)
    last = spark.createDataFrame([(s, *x[:2], *x[3:]) for s, x in state.items()], "end_source string, end_rank long, left long, bits int, prefix long")
    order = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 1)
    same = (F.col("bits") == 0) | (F.expr("shiftright(ordered, 63 - bits)") == F.col("prefix"))
    inside = ranked.withColumn("ordered", order).join(F.broadcast(last), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("rank") == F.col("end_rank")) & same)
    ties = inside.groupBy("source", "left", "h", "own").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    ties = ties.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("h", "own")))
    cuts = ties.where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("size") < F.col("left"))).select("source", "h", "own", F.floor((F.col("left") - F.col("upto") + F.col("size")) / F.col("n")).alias("words")).collect()
    cut = {r.source: r for r in cuts}
    quotas = np.array([s.passes * s.blocks + (end[s.name].rank + 1 if s.name in end else 0) for s in sources], np.int64)
    upto = split_quotas(quotas, shards).cumsum(axis=0)
    made = []
    for k, s in enumerate(sources):
        e, c = end.get(s.name), cut.get(s.name)
        made.append((s.name, s.size, s.target, s.blocks, s.factor, s.shift, s.passes, e.rank if e else -1, c.h if c else None, c.own if c else None, c.words if c else 0, upto[:, k].tolist()))
    return spark.createDataFrame(made, PLAN_SCHEMA)


def _shard_of(index: Column, quota: Column, shards: int) -> Column:
    """The number of the shards' upper ends that are at most an index, found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(shards.bit_length()))])
    ends = lambda at: F.when(at <= shards, F.try_element_at(quota, at)) <= index
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(ends(at + step), F.lit(False)), at + step).otherwise(at))


def _drawn(docs: DataFrame, the_plan: DataFrame, id_col: str, text_col: str, source_col: str, name: str) -> DataFrame:
    """The rows with one more column ``name``: a struct of ``size``, ``source_size``, ``target`` and ``draws``."""
    h, own = _key(id_col, text_col)
    shards = the_plan.agg(F.max(F.size("quota"))).first()[0] or 1
    # everything that is the plan's lies in one struct, so no column of the rows can have its name
    p = the_plan.select(F.struct("*").alias(f"{name}_plan"))
    of = lambda c: F.col(f"{name}_plan")[c]
    at = F.struct(word_count(F.col(text_col)).alias("size"), F.struct(h.alias("h"), own.alias("own")).alias("key"))
    joined = docs.withColumn(f"{name}_row", at).join(F.broadcast(p), F.col(source_col).eqNullSafe(of("source")))  # a row for each source
    size, here = F.col(f"{name}_row")["size"], F.col(f"{name}_row")["key"]
    blocks, last = of("blocks"), of("last_rank")
    there = F.struct(of("cut_hash").alias("h"), of("cut_key").alias("own"))
    rank = F.pmod(F.pmod(here["h"], blocks) * of("factor") + of("shift"), blocks)
    part = F.when(rank < last, size).when((rank > last) | of("cut_hash").isNull(), 0).when(here < there, size).when(here == there, F.least(size, of("cut_words"))).otherwise(0)
    joined = joined.withColumn(f"{name}_place", F.struct(rank.alias("rank"), part.alias("part")))
    place = F.col(f"{name}_place")

    def draw(n: Column) -> Column:
        shard = _shard_of(n * blocks + place["rank"], of("quota"), shards)
        words = F.when(n < of("passes"), size).otherwise(place["part"])
        return F.struct(n.cast("int").alias("pass"), words.cast("long").alias("words"), shard.cast("int").alias("shard"), F.xxhash64(F.lit(SEED + 1), here, n).alias("key"))

    draws = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), of("passes")), draw), lambda d: d.words > 0).cast(DRAW)
    out = F.struct(size.alias("size"), of("source_size").alias("source_size"), of("target").alias("target"), draws.alias("draws"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], out.alias(name))


def _free(names: list[str]) -> str:
    """A prefix that no column's name has."""
    return next(p for p in (f"mix{k}" for k in range(len(names) + 1)) if not any(c.lower().startswith(p) for c in names))


def drawn(docs: DataFrame, the_plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows with ``size``, ``source_size``, ``target`` and ``draws``: pass, words, shard and local order of each copy.

    The new columns replace columns of the same names.
    """
    new, name = ("size", "source_size", "target", "draws"), _free(docs.columns)
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in new]
    return _drawn(docs, the_plan, id_col, text_col, source_col, name).select(*kept, *[F.col(name)[c].alias(c) for c in new])


def mixed(docs: DataFrame, the_plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: a row for each copy, shard by shard, each in its local random order.

    Each shard is a partition.  The row at which a source's target is met is cut to the words that are still wanted.  Other columns go
    along as they are; a column ``shard`` is replaced.
    """
    cols, name = [c for c in docs.columns if c.lower() != "shard"], _free(docs.columns)
    shards = the_plan.agg(F.max(F.size("quota"))).first()[0] or 1
    rows = _drawn(docs.select(*[f"`{c}`" for c in cols]), the_plan, id_col, text_col, source_col, name)
    rows = rows.withColumn(f"{name}_draw", F.explode(F.col(name)["draws"]))
    draw = F.col(f"{name}_draw")
    first = F.array_join(F.slice(F.filter(F.split(text_col, WORD_GAP), lambda w: w != ""), F.lit(1), draw["words"].cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(draw["words"] < F.col(name)["size"], first).otherwise(F.col(text_col)))
    placed = rows.repartitionById(shards, draw["shard"]).sortWithinPartitions(draw["key"])
    return placed.select(*[f"`{c}`" for c in cols], draw["shard"].alias("shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d.words)
    return drawn(docs, plan(docs)).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.transform("draws", lambda d: d.shard).alias("shards"))


QUERIES = {"op9_mixing": op9_mixing}
ORACLE_SQL: dict[str, str] = {}
