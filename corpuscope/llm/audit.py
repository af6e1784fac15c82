"""Filter interaction audit from one SQL CUBE (operator 12).

Every document has five failure flags and a part.  Documents are first counted by part and flags, 32 rows for each part at most, and
only these meet the cube over the flags and the part.  A grouping set of the cube is a subset of filters; its row whose
selected flags are all false says what survives that subset.  A step of an order is the step from one subset to the next larger one, so each of the
600 steps joins the rows of two subsets, and nothing is counted again for an order.

Identical texts are told by SHA-256.  The smallest id of each text is found by a partial aggregation and comes back to the rows by (text, id), so a text that
a third of all rows have is no hot key; equal rows are counted together before they meet their labels.

Defined results: a null text is empty; a null part is the empty string; a row without an id is a document of its part that is never identical to a
smaller id, nor a smaller id for others; rows that repeat an id and its text are each counted, and none makes the other a copy; an id
counts as labelled if any of its rows in ``labels`` is 1, null labels count as 0; texts of any length are read whole; empty tables give no rows; of
other columns only those named are read, so their names cannot clash.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import WORD_GAP, table, word_count
from corpuscope.shared import written

FILTERS = "ABCDE"
#: The failure conditions: fewest words, distinct words and capitals in a hundred, marks that a clean text has none of.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n", "good", "toxic")


def text_flags(text: Column) -> dict[str, Column]:
    """Failure conditions that depend on a text alone, by letter."""
    body = F.coalesce(text, F.lit(""))
    words = word_count(body)
    distinct = F.size(F.array_remove(F.array_distinct(F.split(body, WORD_GAP)), "")).cast("long")
    capitals = F.length(body) - F.length(F.translate(body, CAPITALS, ""))
    return {
        "A": words < FEWEST_WORDS, "B": 100 * distinct < LEAST_DISTINCT * words,
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(body).cast("long"), "D": body.rlike(MARKS),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Counts (n, good, toxic) of documents by part and the five flags."""
    flags = text_flags(F.col(text_col))
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), *[c.alias(k) for k, c in flags.items()])
    rows = written(rows.groupBy("id", "digest", "part", *flags).agg(F.count(F.lit(1)).alias("n")), "audit-rows")  # some 60 bytes a document
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("E", F.lit(False))
    # the smallest id of its text fails nothing; a row without an id meets no row here and has no smaller id either
    rows = rows.join(first, ["id", "digest"], "left").withColumn("E", F.coalesce("E", F.col("id").isNotNull()))
    marks = labels.where("quality = 1 OR toxic = 1").groupBy(F.col("doc_id").alias("id")).agg(*[F.max((F.col(c) == 1).cast("long")).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.groupBy("id", "part", *FILTERS).agg(F.sum("n").alias("n")).join(marks, "id", "left")
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    return rows.groupBy("part", *FILTERS).agg(*sums)


def survivors(counts: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): what passes every filter of a subset, for each of the 32 subsets.

    ``subset`` has a bit for each filter, the first filter's the lowest.
    """
    cube = counts.cube("part", *FILTERS).agg(*[F.sum(m).alias(m) for m in MEASURES], F.grouping("part").alias("all_parts"), *[F.grouping(f).alias(f"any_{f}") for f in FILTERS])
    chosen = [F.col(f"any_{f}") == 0 for f in FILTERS]
    passing = [~c | ~F.col(f) for c, f in zip(chosen, FILTERS, strict=True)]
    subset = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(chosen)), F.lit(0))
    kept = cube.where(F.col("all_parts") == 0)
    for p in passing:
        kept = kept.where(p)
    found = kept.select("part", subset.alias("subset"), *MEASURES)
    # a subset that nothing survives has no row in the cube
    every = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").fillna(0, list(MEASURES))


def steps(spark: SparkSession) -> DataFrame:
    """(filter_order, step, filter, before, after) of every step of every order: 600 rows."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows = [("".join(o), k + 1, o[k], sum(bit[f] for f in o[:k]), sum(bit[f] for f in o[: k + 1])) for o in permutations(FILTERS) for k in range(len(o))]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from the counts by part and flags."""
    left = written(survivors(written(counts, "audit-counts")), "audit-survivors")  # 32 rows for each part
    bits = range(len(FILTERS))
    # a row for each part, with what survives each subset as an array
    whole = left.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("subset", *MEASURES))), lambda s: s["n"]).alias("n"))
    at = lambda subset: F.element_at("n", F.lit(subset + 1))
    full = (1 << len(FILTERS)) - 1

    def shapley(k: int) -> Column:
        """The filter's removed, over all orders: a subset before it stands for the orders of its filters and of those that follow."""
        others = [s for s in range(full + 1) if not s >> k & 1]
        ways = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())
        return sum((F.lit(ways(s)) * (at(s) - at(s | 1 << k)) for s in others), F.lit(0))

    own = [F.struct(F.lit(FILTERS[k]).alias("filter"), (at(0) - at(1 << k)).alias("failing"), (at(full ^ 1 << k) - at(full)).alias("unique_fails"), shapley(k).alias("shapley")) for k in bits]
    by_filter = whole.select("part", F.inline(F.array(*own)))
    pair = lambda name: left.select("part", F.col("subset").alias(name), F.struct(*MEASURES).alias(f"at_{name}"))
    plan = F.broadcast(steps(left.sparkSession))  # 600 rows
    rows = pair("before").join(plan, "before").join(pair("after"), ["part", "after"]).join(by_filter, ["part", "filter"])
    b, a = F.col("at_before"), F.col("at_after")
    removed = b["n"] - a["n"]
    return rows.select(
        "part", "filter_order", "step", a["n"].alias("kept"), removed.alias("removed"), (F.col("failing") - removed).alias("redundant"), "unique_fails",
        (b["good"] - a["good"]).alias("good_lost"), (b["toxic"] - a["toxic"]).alias("toxic_lost"), F.col("shapley").cast("long").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of the five filters keeps and removes in each source."""
    return audit(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_FAILS = {
    "A": "len(w) < 200", "B": "100 * len(list_distinct(w)) < 50 * len(w)", "C": "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t)",
    "D": "regexp_matches(t, '[#$%&*|]')", "E": "coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)",
}
SQL = f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce(quality, 0)) = 1 AS good, max(coalesce(toxic, 0)) = 1 AS toxic FROM labels GROUP BY 1),
f AS (SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [{", ".join(_FAILS.values())}] AS fails FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
stepped AS (SELECT part, filter_order, step, n, good, toxic, fails[ascii(filter_order[step]) - 64] AS failing,
  len(list_filter(fails, lambda x: x)) AS n_fails, coalesce(list_bool_or(list_transform(range(1, step), lambda k: fails[ascii(filter_order[k]) - 64])), false) AS gone FROM counted, steps),
audit AS (SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (gone AND failing), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failing AND n_fails = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (NOT gone AND failing), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0)::BIGINT AS toxic_lost FROM stepped GROUP BY 1, 2, 3)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM audit"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE_SQL = {"op12_filter_audit": SQL}
