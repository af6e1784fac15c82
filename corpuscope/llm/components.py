"""Connected components of links that may be far too many for one machine.

Alternating large-star and small-star steps, each one aggregation and one join.  Edges are rewritten
towards the smallest neighbour until every node hangs on its component's smallest node.  Each round is written to the shared
folder, so that lost executors cost one round at most and lineage does not grow; the round before is deleted then.

The hub of a large component is one key with as many rows as the component has nodes.  Smallest neighbours are found by
aggregations, which combine in each task; for the join, hubs with more than one in ``MAX_HUBS`` of all rows have
their rows salted.  There are ``MAX_HUBS`` of them at most, so their list is broadcast.  With ``HUB_ROWS`` rows or fewer in all, a window
gives the same in one shuffle.  Rounds end when every node hangs on a root; their number grows with the logarithm of the
longest path, and none is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.shared import drop_path, new_path, written

MAX_HUBS, SALTS = 1000, 64
#: Rows of a hub that one task takes in any case.
HUB_ROWS = 100_000


def _star(edges: DataFrame, small: bool, n_edges: int) -> DataFrame:
    """One step: the neighbours of each node (its smaller ones if ``small``, else its larger ones) go to the smallest."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if not small:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if 2 * n_edges <= HUB_ROWS:  # no hub is too much for one task
        joined = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    else:
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        hub = F.col("n") > max(HUB_ROWS, 2 * n_edges // MAX_HUBS)
        hubs = least.where(hub).select(F.col("u").alias("hub"))
        salted = both.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")  # MAX_HUBS rows at most
        salted = salted.withColumn("salt", F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0)).drop("hub")
        spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(hub, SALTS - 1).otherwise(0).cast("long"))))
        joined = salted.join(spread.hint("merge"), ["u", "salt"])
    if not small:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    ends = F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")
    return joined.select(ends).select("e.a", "e.b").where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node that is not a root has one edge, to a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    ups = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("n"), F.min("up").alias("lo"))
    return ups.where("n > 1 OR (n = 1 AND lo = 0)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, its root being its component's smallest node.

    Nulls and loops link nothing; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    path = new_path(spark, "edges")
    ordered = edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b AND a IS NOT NULL AND b IS NOT NULL")
    now = written(ordered.distinct(), "edges", path)
    n = now.count()  # there are never more edges than at first
    while not _settled(now):
        old, path = path, new_path(spark, "edges")
        now = written(_star(_star(now, False, n), True, n), "edges", path, n)
        drop_path(spark, old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
