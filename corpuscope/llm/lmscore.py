"""Language-model scores by cross-entropy difference (operator 1).

Two n-gram models, one of a target corpus and one of the background, share one closed vocabulary, the
256 bytes of UTF-8 text, and one smoothing: each order is mixed with the next lower one by a prior of
``PRIOR`` counts, down to the uniform distribution.  They share no document: the background is every document that is not the target's.  They are matched in
size too: the background's counts are scaled to the target's number of tokens, as a random background of that size has them in
expectation, so no document is left out to make the sizes equal.  So the models differ in what they saw alone.  A text's score is the mean over its tokens of the target model's loss minus the background
model's, in nats; the lower, the more a text resembles the target.

Documents are scored out of fold: a text's hash puts it into one of ``FOLDS`` folds, with every copy of it whatever their ids, and the counts of its
own fold are taken out of both models.  Texts that were not trained on are scored by all counts.  N-grams that a model never saw have count
0, and the smoothing falls back to the longest context it knows.

There is one way at every size.  Rows are dealt by hash into parts of about ``PART_BYTES``, each of one fold.  A part's
distinct n-grams are summed in a task, meet the counts of all parts in joins, and come back to their part with both losses; so
a task holds the n-grams of one part, however large the models grow.  N-grams that are everywhere come once for each part.

Defined results: a null or empty text has no tokens and null losses and score; without target rows both models are
uniform and all scores 0; rows that repeat count and score each; texts of any length are read to their end, in
pieces; a row in several target labels counts once; rows without an id are background; an empty table gives an empty result;
extra columns are not kept, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import chunks, table
from corpuscope.shared import new_path, passing, written

ORDER = 5
TOKENS = 256
PRIOR = 8.0
FOLDS = 4
#: A part's view of the counts: without its own fold's, or, as the last one, all of them.
VIEWS = FOLDS + 1
PIECE = 1 << 20
PART_BYTES = 16 << 20
HELD_GRAMS = 2_000_000
SIDES = ("background", "target")
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double"


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, packed n-gram) for each token of the texts; zeros stand before a text's first bytes."""
    lead = bytes(ORDER - 1)

    def packed(body: bytes) -> np.ndarray:
        raw = np.frombuffer(body, np.uint8).astype(np.int64)
        out = np.zeros(max(0, len(raw) - ORDER + 1), np.int64)
        for k in range(ORDER):
            out = out << 8 | raw[k : len(raw) - ORDER + 1 + k]
        return out

    for a, b in chunks(texts, PIECE):
        bodies = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        if len(bodies) == 1:
            for at in range(0, len(bodies[0]), PIECE):
                before = bodies[0][at - ORDER + 1 : at] if at >= ORDER - 1 else (lead + bodies[0][:at])[-ORDER + 1 :]
                found = packed(before + bodies[0][at : at + PIECE])
                yield np.full(len(found), a), found
        else:
            found = packed(lead + lead.join(bodies) + lead)
            size = np.array([len(x) for x in bodies])
            # every text is followed by as many n-grams that end in the zeros before the next one
            own = np.repeat(np.arange(a, b), size + ORDER - 1)
            ends = np.cumsum(size + ORDER - 1)
            keep = np.ones(len(own), bool)
            for k in range(ORDER - 1):
                keep[ends - 1 - k] = False
            yield own[keep[: len(own)]], found[keep[: len(found)]]


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts)


def placed(docs: DataFrame, trained_on: bool = True) -> tuple[DataFrame, int]:
    """(part, doc_id, text) by hash of id and text, and the number of parts; a part modulo ``VIEWS`` is its view of the counts."""
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    views = FOLDS if trained_on else 1
    n = max(1, ceil(size / (views * PART_BYTES)))
    view = F.pmod(F.xxhash64(F.lit("fold"), F.coalesce(F.col("text"), F.lit(""))), F.lit(FOLDS)) if trained_on else F.lit(FOLDS)
    part = view + VIEWS * F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    return docs.select(part.cast("int").alias("part"), F.col("doc_id").cast("long"), "text"), VIEWS * n


def _by_part(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows of a part in a task of their own."""
    return rows.repartitionById(n, "part").sortWithinPartitions("part", *order)


def gathered(rows: DataFrame, n_parts: int, target_ids: DataFrame | None = None) -> DataFrame:
    """(part, gram, n, in_target): the n-grams of each part, and how many of them are in target documents.

    Target ids come to the parts that hold them first, in a join of ids alone.  They grow with the documents and are never
    broadcast.
    """
    texts = rows.withColumn("kind", F.lit(1))
    if target_ids is not None:
        marks = target_ids.select(F.col("doc_id").cast("long")).where(F.col("doc_id").isNotNull()).distinct()
        here = rows.select("part", "doc_id").distinct().join(marks.hint("merge"), "doc_id")
        texts = texts.unionByName(here.select("part", "doc_id", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, marked, held = None, set(), (np.zeros(0, np.int64),) * 3

        def out() -> Iterator[pa.RecordBatch]:
            for x in range(0, len(held[0]), 200_000):
                columns = [pa.array(c[x : x + 200_000]) for c in held]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), now, np.int32)), *columns], ["part", "gram", "n", "in_target"])

        for b in batches:
            part = b.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y and part[x] != now:
                    yield from out()
                    now, marked, held = int(part[x]), set(), (np.zeros(0, np.int64),) * 3
                kind, ids, bodies = (b.column(c).slice(x, y - x).to_pylist() for c in ("kind", "doc_id", "text"))
                marked.update(i for k, i in zip(kind, ids, strict=True) if not k)
                side = np.array([i in marked for i in ids], np.int64)
                for own, gram in grams(bodies):
                    key, n = np.unique(gram << 1 | side[own], return_counts=True)
                    held = _summed(*(np.concatenate(z) for z in zip(held, (key >> 1, n, n * (key & 1)), strict=True)))
                    if len(held[0]) > HELD_GRAMS:
                        yield from out()
                        held = (np.zeros(0, np.int64),) * 3
        yield from out()

    return _by_part(texts, n_parts, "kind").mapInArrow(run, "part int, gram long, n long, in_target long")


def counted(per_part: DataFrame) -> DataFrame:
    """(gram, background_0 .., target_0 ..): counts of each n-gram by fold."""
    view = F.pmod("part", F.lit(VIEWS))
    sides = zip(SIDES, (F.col("n") - F.col("in_target"), F.col("in_target")), strict=True)
    sums = [F.sum(F.when(view == f, c).otherwise(0)).alias(f"{s}_{f}") for s, c in sides for f in range(FOLDS)]
    return per_part.groupBy("gram").agg(*sums)


def with_unseen(counts: DataFrame, per_part: DataFrame) -> DataFrame:
    """The counts with the n-grams of other texts among them, so that these have losses as well."""
    new = per_part.select("gram").distinct().join(counts.select("gram"), "gram", "left_anti")
    return counts.unionByName(new.select("gram", *[F.lit(0).cast("long").alias(c) for c in counts.columns if c != "gram"]))


def losses(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(gram, background_loss, target_loss): both models' loss of an n-gram's last token after the ones before it, by view."""
    names = [f"{s}_{v}" for s in SIDES for v in range(VIEWS)]

    def without(s: str, v: int) -> Column:
        every = sum((F.col(f"{s}_{f}") for f in range(FOLDS)), F.lit(0).cast("long"))
        return (every - F.col(f"{s}_{v}") if v < FOLDS else every).alias(f"{s}_{v}")

    order = {ORDER: written(counts.select("gram", *[without(s, v) for s in SIDES for v in range(VIEWS)]), "grams")}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        order[k] = written(order[k + 1].groupBy(tail.alias("gram")).agg(*[F.sum(c).alias(c) for c in names]), "grams")
    total = order[1].agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    scale = {c: 1.0 for c in names}
    for v in range(VIEWS):
        scale[f"background_{v}"] = total[f"target_{v}"] / max(1, total[f"background_{v}"])

    def smoothed(c: str, context: Column, lower: Column) -> Column:
        return ((F.col(c) * scale[c] + prior * lower) / (context * scale[c] + prior)).alias(f"p_{c}")

    p = order[1].select("gram", *[smoothed(c, F.lit(float(total[c])), F.lit(1.0 / TOKENS)) for c in names])
    for k in range(2, ORDER + 1):
        # tables of orders up to two have at most TOKENS**2 rows
        small = F.broadcast if k <= 3 else lambda df: df
        context = order[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(*[F.sum(c).alias(f"context_{c}") for c in names])
        lower = p.select(F.col("gram").alias("tail"), *[F.col(f"p_{c}").alias(f"lower_{c}") for c in names])
        joined = order[k].withColumn("context", F.shiftright("gram", 8)).withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        joined = joined.join(small(context), "context").join(small(lower), "tail")
        p = joined.select("gram", *[smoothed(c, F.col(f"context_{c}"), F.col(f"lower_{c}")) for c in names])
    return p.select("gram", *[F.array(*[-F.log(f"p_{s}_{v}") for v in range(VIEWS)]).alias(f"{s}_loss") for s in SIDES])


def looked_up(rows: DataFrame, n_parts: int, per_part: DataFrame, by_gram: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of rows (part, doc_id, text); every n-gram of a part is in ``per_part``."""
    view = F.pmod("part", F.lit(VIEWS)) + 1
    own = per_part.select("part", "gram").distinct().join(by_gram.hint("merge"), "gram")
    own = own.select("part", F.lit(0).alias("kind"), "gram", *[F.element_at(f"{s}_loss", view).alias(s) for s in SIDES], F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("part", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("gram"), *[F.lit(None).cast("double").alias(s) for s in SIDES], "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for b in batches:
            part, kind = b.column("part").to_numpy(), b.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(part)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y and part[x] != now:
                    now, held, known = int(part[x]), [], None
                if x < y and not kind[x]:
                    held.append([b.column(c).slice(x, y - x).to_numpy() for c in ("gram", *SIDES)])
                elif x < y:
                    if known is None:
                        known = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
                    yield scored(b.slice(x, y - x), *known)

    def scored(b: pa.RecordBatch, gram: np.ndarray, background: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        count, sums = np.zeros(b.num_rows, np.int64), np.zeros((2, b.num_rows))
        for own, found in grams(b.column("text").to_pylist()):
            unique, at = np.unique(found, return_inverse=True)
            where = np.searchsorted(gram, unique)
            if len(unique) and (where[-1] >= len(gram) or (gram[where] != unique).any()):
                raise RuntimeError("an n-gram of the texts has no loss")
            for k, values in enumerate((target[where], background[where])):
                sums[k] += np.bincount(own, values[at], minlength=b.num_rows)
            count += np.bincount(own, minlength=b.num_rows)
        mean = [pa.array(s / np.maximum(count, 1), pa.float64(), mask=count == 0) for s in sums]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count), *mean], ["doc_id", "n_tokens", "target_loss", "background_loss"])

    found = _by_part(own.unionByName(texts), n_parts, "kind", "gram").mapInArrow(run, SCORES)
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _written_losses(counts: DataFrame) -> DataFrame:
    """The table of losses, without the tables of the orders on the way to it."""
    path = new_path(counts.sparkSession, "gram-losses")
    with passing(counts.sparkSession, path):
        return written(losses(counts), "gram-losses", path)


def trained(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """The counts behind both models: documents with an id in ``target_ids`` are target, all others background."""
    return written(counted(gathered(*placed(docs), target_ids)), "gram-counts")


def scored(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Scores of texts that were not trained on."""
    rows, n = placed(docs, trained_on=False)
    per_part = written(gathered(rows, n), "part-grams")
    return looked_up(rows, n, per_part, _written_losses(with_unseen(counts, per_part)))


def scored_out_of_fold(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Train on the documents and score each of them by what the other folds hold."""
    rows, n = placed(docs)
    per_part = written(gathered(rows, n, target_ids), "part-grams")
    return looked_up(rows, n, per_part, _written_losses(counted(per_part)))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cross-entropy difference between good-quality documents and all others, out of fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored_out_of_fold(docs, table(spark, sf_dir, "labels").where("quality = 1"))


QUERIES = {"op1_lm_score": op1_lm_score}
ORACLE_SQL: dict[str, str] = {}
