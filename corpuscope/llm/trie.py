"""Prefix trie of conversations by smallest-member ownership (operator 13).

A node of the trie is a distinct sequence of first turns, and its smallest member owns it.  Along a conversation's path owners only grow, so
what a conversation owns is a suffix of its path: from the depth where it becomes the smallest member to its end.  A node's
subtree is then known from its members alone: the tokens of all nodes below it are those of its members' turns from there on, and those of the
distinct nodes below it are the same sum over what the members own.  One group-by of the prefixes adds up, over a node's members, the tokens
of their turns minus the tokens they own, their flags of leaves, and their flags of owned children.

No conversation and no node is ever gathered: turns are cut by ranges of (conversation, turn) into runs, windows number and add up within a
run, and what the runs before it hold comes from their sums, a row for each run.  A prefix is known by the exclusive or of two
64-bit hashes of each turn and its place, which runs add up as well.  Owners are found by a partial aggregation, not by a window over a node's members, because
the root's members are all conversations.  Nodes with very many members, of which there are at most ``HUBS``, are looked up by broadcast, all others by sorting.  The
ids that end at a node are joined in pieces by ranges of ids, and the digest reads the pieces in order.

Defined results: rows without a conversation id are left out; turns without a number come first; turns of equal number are in the order of a
digest of role and text; null roles and texts are empty; repeated rows are turns of their own; texts of any length are hashed whole; an empty table has no
nodes, not even a root; of other columns only those named are read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.llm.common import table
from corpuscope.shared import written

#: Conversations of a hundred begin with the first of them, cut to fewer than ``HEADS`` turns.
GROUP, HEADS = 100, 6
#: At most so many nodes are broadcast: those with more than this share of all (conversation, depth) rows.
HUBS, HUB_LEAST = 10_000, 1_000
#: Ids that agree but for so many bits are joined into one piece of a node's digest.
PIECE_BITS = 10
RUN, NODE = ("run", "conv_id"), ("depth", "p1", "p2")
#: The number of the run that holds what a conversation has from its base; it is before all others.
HEAD_RUN = -1


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, tokens): a turn's contents as a digest and a number of code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("tokens"))


def _runs(rows: DataFrame) -> DataFrame:
    """The rows with ``run``, the number of one of the consecutive ranges of (conv_id, turn) that they are cut into; written."""
    spread = F.monotonically_increasing_id()  # tells rows apart that are equal otherwise, so that they can be cut as well
    cut = rows.withColumn("row", spread).repartitionByRange("conv_id", "turn", "digest", "row").withColumn("run", F.spark_partition_id())
    return written(cut.drop("row"), "trie-runs")


def _earlier(value: Column) -> Column:
    """What the earlier runs of a conversation add up to, over a row for each conversation and run."""
    return F.coalesce(value.over(Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, run, length, depth, digest, tokens): the turns of every rebuilt conversation and, at depth 0, its beginning without text."""
    rows = _runs(_turns(conversations))
    runs = rows.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")).withColumn("offset", _earlier(F.sum("n")))
    own = runs.groupBy("conv_id").agg(F.sum("n").alias("own"))
    bases = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    cut = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = own.withColumn("h", cut).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(bases, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = convs.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    at = F.row_number().over(Window.partitionBy(*RUN).orderBy(F.asc_nulls_first("turn"), "digest"))
    known = runs.join(convs, "conv_id").select(*RUN, "offset", "h", "k", "length")
    turns = rows.withColumn("at", at).join(known, [*RUN]).withColumn("i", F.col("offset") + F.col("at"))
    turns = written(turns.select(*RUN, "i", "h", "k", "length", "digest", "tokens"), "trie-turns")
    kept = turns.where("i > h").select(*RUN, "length", (F.col("i") - F.col("h") + F.col("k")).alias("depth"), "digest", "tokens")
    first = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("i") < HEADS)).select(F.col("conv_id").alias("base"), "i", "digest", "tokens")
    heads = convs.where("k > 0").join(first, "base").where("i <= k")  # at most 199 conversations of a base and HEADS - 1 turns
    heads = heads.select(F.lit(HEAD_RUN).alias("run"), "conv_id", "length", F.col("i").alias("depth"), "digest", "tokens")
    roots = convs.select(F.lit(HEAD_RUN).alias("run"), "conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("tokens"))
    return kept.unionByName(heads).unionByName(roots)


def occurrences(turns: DataFrame) -> DataFrame:
    """(conv_id, run, length, depth, p1, p2, q1, q2, before, tokens): every prefix of every path.

    (p1, p2) stands for the prefix, (q1, q2) for the one a turn shorter; ``before`` is the code points of the turns before the last.
    """
    marks = [F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(0) for seed in (1, 2)]
    turns = turns.select(*RUN, "length", "depth", marks[0].alias("m1"), marks[1].alias("m2"), "tokens")
    upto = Window.partitionBy(*RUN).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select("*", *[F.bit_xor(m).over(upto).alias(f"x{m[1]}") for m in ("m1", "m2")], F.sum("tokens").over(upto).alias("upto"))
    rows = written(rows, "trie-paths")
    sums = rows.groupBy(*RUN).agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"), F.sum("tokens").alias("s"))
    earlier = sums.select(*RUN, _earlier(F.bit_xor("s1")).alias("e1"), _earlier(F.bit_xor("s2")).alias("e2"), _earlier(F.sum("s")).alias("e"))
    p = [F.col(f"x{k}").bitwiseXOR(F.col(f"e{k}")) for k in (1, 2)]
    found = rows.join(earlier, [*RUN]).select(
        *RUN, "length", "depth", *[x.alias(f"p{k + 1}") for k, x in enumerate(p)], *[x.bitwiseXOR(F.col(f"m{k + 1}")).alias(f"q{k + 1}") for k, x in enumerate(p)],
        (F.col("e") + F.col("upto") - F.col("tokens")).alias("before"), "tokens",
    )
    return written(found, "trie-occurrences")


def _owned(occ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p1, p2, owner, n_convs) of every node, and (conv_id, start, before, q1, q2, leaf) of every conversation that owns nodes."""
    least = F.min(F.struct("conv_id", "before", "q1", "q2"))
    nodes = occ.groupBy(*NODE).agg(least.alias("o"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("longest"))
    nodes = written(nodes.select(*NODE, F.col("o")["conv_id"].alias("conv_id"), "n_convs", (F.col("longest") == F.col("depth")).alias("leaf"), *[F.col("o")[c].alias(c) for c in ("before", "q1", "q2")]), "trie-owners")
    own = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before", "q1", "q2")).alias("s"), F.max("leaf").alias("leaf"))
    return nodes, own.select("conv_id", F.col("s")["depth"].alias("start"), *[F.col("s")[c].alias(c) for c in ("before", "q1", "q2")], "leaf")


def _parents(nodes: DataFrame, own: DataFrame, total: int) -> DataFrame:
    """(conv_id, depth, parent_conv_id) of the first node that each conversation owns; of its later ones the parent is its own."""
    hub = F.col("n_convs") > max(HUB_LEAST, total // HUBS)
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_convs")
    edges = own.where("start > 0").select("conv_id", F.col("start").alias("depth"), "q1", "q2")
    key = ["q1", "q2", "depth"]
    near = edges.join(F.broadcast(above.where(hub).drop("n_convs")), key, "left")  # HUBS rows at most: their members are rows of the occurrences
    far = near.where("parent_conv_id IS NULL").drop("parent_conv_id").join(above.where(~hub).drop("n_convs").hint("merge"), key)
    return near.where("parent_conv_id IS NOT NULL").unionByName(far).select("conv_id", "depth", "parent_conv_id")


def _ends(occ: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256): digests of the ids that end at each node, for nodes where any ends."""
    ids = occ.where("depth = length").groupBy(*NODE, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # at most 1 << PIECE_BITS ids
    pieces = ids.select(*NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        done: list[tuple] = []
        for b in batches:
            for *node, text in zip(*(b.column(c).to_pylist() for c in (*NODE, "text")), strict=True):
                if node != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            if done:
                yield _digest_rows(done)
                done = []
        if now:
            yield _digest_rows([(*now, sha.hexdigest())])

    # a digest is sequential: a task reads the pieces of a node one after another and holds none of them
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(run, "depth long, p1 long, p2 long, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [*NODE, "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations."""
    occ = occurrences(rebuilt(conversations))
    nodes, own = _owned(occ)
    # what a member brings to a node: the tokens between the node and the first node that the member owns, and flags
    totals = occ.groupBy(*RUN).agg(F.sum("tokens").alias("tokens"))
    convs = totals.groupBy("conv_id").agg(F.sum("tokens").alias("total")).join(own.select("conv_id", "start", F.col("before").alias("shared"), "leaf"), "conv_id", "left")
    convs = convs.select("conv_id", "start", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"))
    members = occ.join(totals.select(*RUN).join(convs, "conv_id"), [*RUN])
    child = (F.col("start") <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    found = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.coalesce(F.sum(F.coalesce(child, F.lit(False)).cast("long")), F.lit(0)).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("shared") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    found = found.join(_ends(occ), [*NODE], "left").join(_parents(nodes, own, occ.count()), ["conv_id", "depth"], "left")
    parent = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


# the crc32 of a decimal id: the usual reflected polynomial, bit by bit
_CRC = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::UBIGINT)), lambda a, b:
  list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)))"""
SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role))::VARCHAR || ':' || role || text)) AS i FROM t),
l AS (SELECT conv_id, max(i) AS own FROM n GROUP BY 1),
h AS (SELECT conv_id, own, ({_CRC} % 6)::BIGINT AS h FROM l),
c AS (SELECT h.conv_id, h.conv_id - h.conv_id % 100 AS base, h.own, h, least(h, coalesce(l.own, 0)) AS k FROM h LEFT JOIN l ON l.conv_id = h.conv_id - h.conv_id % 100),
r AS (SELECT c.conv_id, i AS d, role, text FROM c JOIN n ON n.conv_id = base WHERE i <= k
  UNION ALL SELECT c.conv_id, i - h + k, role, text FROM c JOIN n ON n.conv_id = c.conv_id WHERE i > h),
o AS (SELECT conv_id, 0 AS d, '' AS p, 0 AS tokens, k + greatest(own - h, 0) AS len FROM c
  UNION ALL SELECT r.conv_id, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY r.conv_id ORDER BY d), length(text), k + greatest(own - h, 0) FROM r JOIN c ON c.conv_id = r.conv_id),
v AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(tokens) AS tokens, max(len) = d AS leaf,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends_sha256 FROM o GROUP BY 1, 2),
s AS (SELECT a.p, a.d, sum(CASE WHEN v.leaf THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.tokens)::BIGINT AS saved_tokens, count(*) FILTER (v.d = a.d + 1) AS n_children
  FROM v JOIN o a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY 1, 2)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN s ON s.p = v.p AND s.d = v.d LEFT JOIN o b ON b.conv_id = v.conv_id AND b.d = v.d - 1 LEFT JOIN v u ON u.p = b.p AND u.d = b.d"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {"op13_prefix_trie": SQL}
