"""Near duplicates by a chosen-path set similarity join (operator 4).

Documents are sets of word shingles.  Documents with equal sets form a class, and classes are what is
joined.  A class has a signature of ``COORDINATES`` minwise tokens.  In a chosen-path tree each node draws a few
coordinates of its tree's pool, one in expectation that a pair at the threshold agrees in, and its classes branch to one
child for each drawn coordinate and token; so similar classes stay together with a constant chance at every depth,
others part.  Nodes of at most ``LEAF`` classes are compared exhaustively.  The trees of the first forest have disjoint
pools, so they are independent, and there are as many as miss a pair at the threshold with less than ``MISS`` probability
(``missed`` computes it).

Only components are wanted, so a node's pairs are never listed: its task compares sketches, keeps
the groups that may be linked, and later compares the full sets of each group by one matrix product over the shared
tokens.  Groups are cut into cells of at most ``SET_TOKENS`` tokens, all pairs of blocks, so long texts do not add up in
a task.  A group whose members are all in one component is finished.

Nodes that are oversized at the last depth are dealt into chunks that share ``LEADERS`` classes.  Where that leaves several
components, up to ``CLUSTER`` classes around one component are compared block by
block, those outside the largest component with all; larger clusters go through a forest of twice the depth, whose number
of trees follows from ``missed`` again, and so on to ``DEEPEST``.  So a class meets a bounded number of others in a
node, whatever the size of its group, and the work grows with the rows.  Nothing is left out: what even the
deepest forest leaves open is compared block by block.

Defined results: a text without words has no shingles and is linked with nothing; a text of fewer words than a shingle is one
shingle; texts of any length are read to their end, in pieces; rows with a null id are linked with nothing and
kept; repeated rows are equal and share a component, of which the smallest id is kept; an empty table gives an empty result; extra
columns are not kept, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscope.llm.common import U64, chunks, mix64, powers, slices, table
from corpuscope.llm.components import connected
from corpuscope.shared import new_path, passing, written

#: Minwise tokens of a class, 32 bits of each; the first forest's trees have ``POOL`` of their own.  Their low bytes are the sketch.
COORDINATES, POOL = 64, 4
#: Classes of a node that one task compares with one another, and of either side of a cell of a larger cluster.
LEAF, TILE = 512, 1024
#: Classes around one component that are compared block by block; more branch deeper.
CLUSTER = 16_384
#: Tokens of the full sets in a cell, beside one set of any size for each of its two blocks.
SET_TOKENS = 1 << 21
ROWS_AT_ONCE = 128
LEADERS = 8
DEPTH, DEEPEST = 2, 8
MISS = 1e-3
PIECE = 1 << 19
MULTIPLIER = 0x9FB21C651E98DF25
#: Deviations below the threshold at which a sketch rules a pair out.
SLACK = 3.5
#: A node's name keeps its tree in the low bits.
TREE_BITS = 8
LOW = U64((1 << TREE_BITS) - 1)

_A = mix64(np.arange(1, COORDINATES + 1, dtype=U64)) | U64(1)
_B = mix64(np.arange(1001, COORDINATES + 1001, dtype=U64))


# --- sets and signatures -------------------------------------------------------------------------


class Shingler:
    """Distinct hashes of runs of ``width`` words, of UTF-8 texts with A-Z in lower case."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.up = self.down = np.zeros(0, U64)

    def word_hashes(self, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and beginning of each word of a buffer; words part at blanks and the five ASCII controls."""
        raw = np.frombuffer(body, np.uint8)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)))
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(raw) >= len(self.up):
            n = max(PIECE * 2, len(raw) + 1)
            self.up, self.down = powers(MULTIPLIER, n), powers(pow(MULTIPLIER, -1, 1 << 64), n)
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum((raw.astype(U64) + U64(1)) * self.up[: len(raw)], out=total[1:])
        return mix64((total[end] - total[start]) * self.down[start] + (end - start).astype(U64)), start

    def _parts(self, body: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(body):
            end = at + PIECE
            while end < len(body) and not body[end : end + 1].isspace():
                end += 1
            yield body[at:end]
            at = end

    def combined(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all runs of n words."""
        out = np.full(len(words) - n + 1, n, U64)
        for k in range(n):
            out = mix64(out * U64(MULTIPLIER) + words[k : len(words) - n + 1 + k])
        return out

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """A sorted array of distinct hashes for each text."""
        for a, b in chunks(texts, PIECE):
            bodies = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[a:b]]
            if b - a == 1 and len(bodies[0]) > PIECE:
                words = np.concatenate([self.word_hashes(p)[0] for p in self._parts(bodies[0])])
                cuts = [0, len(words)]
            else:
                words, start = self.word_hashes(b"\n".join(bodies))
                begins = np.cumsum([0, *(len(x) + 1 for x in bodies)])
                cuts = np.searchsorted(start, begins).tolist()
            runs = self.combined(words, self.width) if len(words) >= self.width else np.zeros(0, U64)
            for x, y in zip(cuts, cuts[1:], strict=False):
                n = y - x
                if n >= self.width:
                    yield np.unique(runs[x : y - self.width + 1])
                else:
                    yield self.combined(words[x:y], n) if n else np.zeros(0, U64)


def signature(tokens: np.ndarray) -> np.ndarray:
    """32 bits of the minwise token of each coordinate: the low ones of the least hash, which are spread evenly."""
    out = np.full(COORDINATES, 0xFFFFFFFFFFFFFFFF, U64)
    for at in range(0, len(tokens), 1024):
        out = np.minimum(out, ((tokens[at : at + 1024, None] ^ _B) * _A).min(axis=0))
    return out.astype(np.uint32)


def class_of(tokens: np.ndarray) -> int:
    """An identifier of a set; equal sets have equal ones."""
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _with_key(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")


def features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n_shingles, class, sig) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in slices(batches):
            made = [(len(s), class_of(s), signature(s).tobytes()) for s in shingler.sets(b.column("text").to_pylist())]
            n, c, sig = zip(*made, strict=True) if made else ((), (), ())
            made = [b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "key", "n_shingles", "class", "sig"])

    return _with_key(docs).mapInArrow(run, "doc_id long, key long, n_shingles long, class long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, tokens) of the wanted (doc_id, key, class), from the whole texts.

    What is wanted grows with the documents: it is never broadcast, so the plan is the same at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in slices(batches):
            got = [(c, s.tobytes()) for c, s in zip(b.column("class").to_pylist(), shingler.sets(b.column("text").to_pylist()), strict=True) if class_of(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], t) for k, t in enumerate((pa.int64(), pa.binary()))], ["class", "tokens"])

    rows = _with_key(docs).join(wanted.hint("merge"), ["doc_id", "key"]).select("class", "text")
    return rows.mapInArrow(run, "class long, tokens binary").dropDuplicates(["class"])


# --- trees ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees of one depth; each draws from a pool of its own, or all from every coordinate where pools have that size."""

    seed: int
    trees: int
    pool: int
    depth: int

    def limit(self, threshold: float) -> np.uint64:
        """Hashes below it draw a coordinate, so that a node draws 1 / threshold of them in expectation."""
        return U64(int((1 << 64) * min(0.999, 1 / (threshold * self.pool))))

    def coordinates(self, tree: np.ndarray) -> np.ndarray:
        """The pool of each tree, a row each."""
        first = (tree * self.pool) % COORDINATES if self.pool < COORDINATES else tree * 0
        return first[:, None] + np.arange(self.pool)

    def roots(self) -> np.ndarray:
        tree = np.arange(self.trees, dtype=U64)
        return mix64(tree + U64(self.seed << 20)) & ~LOW | tree

    def drawn(self, node: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, coordinate) of all coordinates that the nodes draw."""
        pool = self.coordinates((node & LOW).astype(np.int64))
        row, at = np.nonzero(mix64(node[:, None] + _B[pool]) < self.limit(threshold))
        return row, pool[row, at]


def _together(agree: int, share: float, depth: int) -> float:
    """Probability that a pair that agrees in so many coordinates of a pool is together in a node some levels deeper.

    Each node draws each coordinate with probability ``share``, and the pair goes on to the children of those it agrees in.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - (1 - share * meet) ** agree
    return meet


def _binomial(n: int, p: float) -> list[float]:
    return [comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


def missed(threshold: float, forest: Forest) -> float:
    """Probability that a pair at the threshold is in no node of the forest's last depth together.

    What roots draw is the same for all pairs, so it is taken as it is; further draws depend on the pair's tokens.
    """
    share = min(0.999, 1 / (threshold * forest.pool))
    at_root = np.bincount(forest.drawn(forest.roots(), threshold)[0], minlength=forest.trees).tolist()
    if forest.pool < COORDINATES:  # each tree has coordinates of its own
        out = 1.0
        for n in at_root:
            rest = _binomial(forest.pool - n, threshold)
            out *= sum(p * q * (1 - _together(i + j, share, forest.depth - 1)) ** i for i, p in enumerate(_binomial(n, threshold)) for j, q in enumerate(rest))
        return out
    out = 0.0
    for agree, p in enumerate(_binomial(COORDINATES, threshold)):
        apart = 1 - _together(agree, share, forest.depth - 1)
        out += p * float(np.prod([(1 - agree / COORDINATES * (1 - apart)) ** n for n in at_root]))
    return out


def forest_for(threshold: float, depth: int, miss: float = MISS) -> Forest:
    """The first forest, or a deeper one, with as many trees as miss a pair at the threshold with that probability at most.

    Pools limit the first one to ``COORDINATES // POOL`` trees, which thresholds of 0.8 or more do not need.
    """
    pool, most = (POOL, COORDINATES // POOL) if depth <= DEPTH else (COORDINATES, (1 << TREE_BITS) - 1)
    for trees in range(1, most):
        if missed(threshold, f := Forest(depth, trees, pool, depth)) <= miss:
            return f
    return Forest(depth, most, pool, depth)


def branched(rows: DataFrame, threshold: float, forest: Forest, roots: bool = False) -> DataFrame:
    """(node, class) of the children of the rows' (node, class, sig) nodes, or of the roots of the forest's trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = forest.roots()
        for b in batches:
            for x in range(0, b.num_rows, 2048):
                part = b.slice(x, 2048)
                c = part.column("class").to_numpy()
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                if roots:
                    of, at = forest.drawn(root, threshold)
                    row, node, at = np.repeat(np.arange(len(c)), len(at)), np.tile(root[of], len(c)), np.tile(at, len(c))
                else:
                    own = part.column("node").to_numpy().astype(U64)
                    row, at = forest.drawn(own, threshold)
                    node = own[row]
                child = mix64(mix64(node + _A[at]) ^ sig[row, at]) & ~LOW | node & LOW
                yield pa.RecordBatch.from_pydict({"node": child.astype(np.int64), "class": c[row]})

    return rows.mapInArrow(run, "node long, class long")


def chunked(big: DataFrame) -> DataFrame:
    """(node, class) of chunks of oversized nodes (node, class, n), the leaders of a node in each of its chunks.

    Each class goes with the largest of its nodes.
    """
    own = big.groupBy("class").agg(F.max_by("node", F.struct("n", "node")).alias("node"))
    hashes = [F.min(F.struct(F.xxhash64("class", "node", F.lit(k)).alias("h"), F.col("class").alias("c"))).alias(f"l{k}") for k in range(LEADERS)]
    nodes = own.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(LEAF - LEADERS)).cast("long").alias("n_chunks"), *hashes)
    dealt = own.join(nodes.select("node", "n_chunks"), "node").select(F.xxhash64("node", F.pmod(F.xxhash64("class", "node"), "n_chunks")).alias("node"), "class")
    each = nodes.select("node", "n_chunks", F.explode(F.array(*[F.col(f"l{k}.c") for k in range(LEADERS)])).alias("class"))
    spread = each.select("node", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("chunk"))
    return dealt.unionByName(spread.select(F.xxhash64("node", F.col("chunk")).alias("node"), "class"))


# --- comparisons inside a node -------------------------------------------------------------------


def merge(label: np.ndarray, i: int, others: np.ndarray) -> bool:
    """Give row i and the others, and all rows of their labels, one label; whether that changed anything."""
    found = np.unique(label[others])
    found = found[found != label[i]]
    if not len(found):
        return False
    every = np.append(found, label[i])
    label[np.isin(label, every)] = every.min()
    return True


def sketch_labels(sketch: np.ndarray, floor_: int) -> np.ndarray | None:
    """A label for each row; rows whose sketches agree in ``floor_`` coordinates are connected.  None if no two do."""
    label, linked = np.arange(len(sketch)), False
    for at in range(0, len(sketch), ROWS_AT_ONCE):
        near = (sketch[at : at + ROWS_AT_ONCE, None, :] == sketch[None, at:, :]).sum(axis=2, dtype=np.uint8) >= floor_
        for k in range(len(near)):
            others = np.flatnonzero(near[k, k + 1 :])
            if len(others):
                linked |= merge(label, at + k, at + k + 1 + others)
    return label if linked else None


def shared_counts(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of some sets share, by products of 0/1 matrices over the tokens that occur twice."""
    n = len(tokens)
    code, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)[1:]
    own, several = np.repeat(np.arange(n), [len(t) for t in tokens]), times > 1
    keep = several[code]
    code, own = (np.cumsum(several) - 1)[code[keep]], own[keep]
    order = np.argsort(code, kind="stable")
    code, own, vocabulary = code[order], own[order], int(several.sum())
    both, width = np.zeros((n, n)), max(64, (1 << 22) // n)
    for at in range(0, vocabulary, width):
        a, b = np.searchsorted(code, (at, at + width))
        x = np.zeros((n, min(width, vocabulary - at)), np.float32)  # whole numbers below 2**24 are exact
        x[own[a:b], code[a:b] - at] = 1
        both += x @ x.T
    return both


def parts_of(link: np.ndarray) -> np.ndarray:
    """A label for each row of a symmetric matrix of links, the number of its part's first row."""
    label = np.full(len(link), -1)
    for i in range(len(link)):
        if label[i] < 0:
            new = np.array([i])
            while len(new):
                label[new] = i
                new = np.flatnonzero(link[new].any(axis=0) & (label < 0))
    return label


def set_labels(tokens: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """A label for each set; sets that are alike enough are connected, all pairs compared on their full sets."""
    size = np.array([len(t) for t in tokens])
    both = shared_counts(tokens)
    return parts_of(den * both >= num * (size[:, None] + size - both))


def by_node(rows: DataFrame, work: Callable[[dict[str, list]], list[tuple]], schema: str, names: list[str]) -> DataFrame:
    """Apply a function to the rows of each node; nodes are bounded and come one after another, sorted."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            node = held.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if last:
                yield from finish(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield from finish(held)

    def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node = t.column("node").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
        values = {c: t.column(c).to_pylist() for c in columns if c != "node"}
        out: list[tuple] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                out += work({c: v[a:b] for c, v in values.items()})
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names)

    return rows.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(run, schema)


def likely_groups(nodes: DataFrame, sketches: DataFrame, floor_: int) -> DataFrame:
    """(node, class, size) of the groups in each node that sketches may link, with each set's size; equal groups of several nodes are one.

    The new node is a hash of the group's members.
    """

    def work(g: dict[str, list]) -> list[tuple]:
        if len(set(g["class"])) < len(g["class"]):
            first = {c: k for k, c in reversed(list(enumerate(g["class"])))}
            g = {name: [v[k] for k in first.values()] for name, v in g.items()}
        label = sketch_labels(np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(-1, COORDINATES), floor_)
        if label is None:
            return []
        out: list[tuple] = []
        groups: dict[int, list[tuple[int, int]]] = {}
        for at, *member in zip(label.tolist(), g["class"], g["size"], strict=True):
            groups.setdefault(at, []).append(tuple(member))
        for members in groups.values():
            if len(members) > 1:
                name = int.from_bytes(blake2b(np.array(sorted(c for c, _ in members), np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)
                out += [(name, *m) for m in members]
        return out

    rows = nodes.join(sketches, "class").select("node", "class", "size", "sketch")
    found = by_node(rows, work, "node long, class long, size long", ["node", "class", "size"])
    return found.groupBy("node", "class").agg(F.first("size").alias("size"))


def in_cells(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, class, comp, tokens): the open ones of the groups (node, class, size, comp) with their full sets, large ones cut into cells.

    A group's sets are dealt by size into blocks of half of ``SET_TOKENS``; where there are several, a cell holds two.
    Groups are of bounded size, so a window may span one.
    """
    whole, order = Window.partitionBy("node"), Window.partitionBy("node").orderBy("size", "class")
    several = F.min("comp").over(whole) != F.max("comp").over(whole)
    now = groups.withColumn("several", several).withColumn("block", F.floor((F.sum("size").over(order) - F.col("size")) / F.lit(SET_TOKENS // 2)))
    dealt = now.withColumn("blocks", F.max("block").over(whole) + 1).where("several")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("blocks = 1 OR other <> block")
    cell = F.when(F.col("blocks") == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")))
    return dealt.select(cell.alias("node"), "class", "comp").join(sets.select("class", "tokens"), "class").select("node", "class", "comp", "tokens")


def confirmed(groups: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) that connect the classes of each group (node, class, size, comp) as far as their full sets do.

    Classes of one component count as connected.
    """
    num, den = share

    def work(g: dict[str, list]) -> list[tuple]:
        label = set_labels([np.frombuffer(x, U64) for x in g["tokens"]], num, den)
        # as stars around the smallest class of each part, which components settle in few rounds
        part: dict[int, list[int]] = {}
        for k, at in enumerate(label.tolist()):
            part.setdefault(at, []).append(k)
        several = [ks for ks in part.values() if len({g["comp"][k] for k in ks}) > 1]
        return [(g["class"][k], least) for ks in several for least in [min(g["class"][k] for k in ks)] for k in ks if g["class"][k] != least]

    return by_node(in_cells(groups, sets), work, "a long, b long", ["a", "b"])


def around(nodes: DataFrame) -> DataFrame:
    """(main, class, outside, n, n_outside) of open nodes (node, class, comp): nodes with the same largest component are one cluster."""
    most = nodes.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"))
    members = nodes.join(most, "node").groupBy("main", "class").agg(F.first(F.col("comp") != F.col("main")).alias("outside"))
    sizes = members.groupBy("main").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outside").cast("long")).alias("n_outside"))
    return members.join(sizes, "main")


def cells(clusters: DataFrame) -> DataFrame:
    """(node, class) cells in which all classes of clusters (main, class, outside, n, n_outside) meet those outside the largest component.

    Both sides are dealt into blocks; a cell holds one block of either side.
    """
    dealt = clusters.withColumn("rows", F.ceil(F.col("n") / TILE)).withColumn("cols", F.ceil(F.col("n_outside") / TILE)).select("main", "class", "outside", "rows", "cols", F.pmod(F.xxhash64("class", "main"), "rows").alias("row"), F.pmod(F.xxhash64("class", "main", F.lit(1)), "cols").alias("col"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_ = dealt.select("main", "class", "row", upto("cols").alias("col"))
    outside = dealt.where("outside").select("main", "class", upto("rows").alias("row"), "col")
    return all_.unionByName(outside).select(F.xxhash64("main", "row", "col").alias("node"), "class")


class Join:
    """The links found so far, as (node, root) rows, and the full sets that were needed for them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, share: tuple[int, int]) -> None:
        self.docs, self.classes, self.width, self.share = docs, classes, width, share
        self.threshold = share[0] / share[1]
        self.floor = int(COORDINATES * (self.threshold - SLACK * (self.threshold * (1 - self.threshold) / COORDINATES) ** 0.5))
        self.sketches = sketch_of(classes)
        self.roots: DataFrame | None = None
        self.sets: DataFrame | None = None

    def with_comp(self, rows: DataFrame) -> DataFrame:
        """Rows (class, ...) with the component of their class."""
        if self.roots is None:
            return rows.withColumn("comp", F.col("class"))
        return rows.join(self.roots.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("root", "class")).drop("root")

    def open(self, nodes: DataFrame) -> DataFrame:
        """The nodes (node, class, ...), of any size, that still hold more than one component, with ``comp``."""
        now = self.with_comp(nodes)
        several = now.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("node")
        return now.join(several, "node")

    def compare(self, nodes: DataFrame, and_later: DataFrame | None = None) -> None:
        """Find all links inside nodes of bounded size (node, class).

        The texts are shuffled once: the first call fetches the sets of its own groups and of the classes ``and_later``, and
        later calls are about those alone.
        """
        groups = written(likely_groups(nodes, self.sketches, self.floor), "groups")
        if self.sets is None:
            wanted = groups.select("class") if and_later is None else groups.select("class").unionByName(and_later.select("class"))
            wanted = wanted.distinct().join(self.classes.select("class", "doc_id", "key"), "class")
            self.sets = written(full_sets(self.docs, wanted, self.width), "sets")
        links = written(confirmed(self.with_comp(groups), self.sets, self.share), "links")
        if not links.isEmpty():
            if self.roots is not None:
                links = links.unionByName(self.roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            self.roots = connected(links)

    def grow(self, members: DataFrame, forest: Forest) -> DataFrame | None:
        """Compare the nodes of a forest over classes (class, sig); the ones left open as too large (node, class, comp), if any."""
        frontier, small, big, n = written(branched(members, self.threshold, forest, roots=True), "frontier"), [], None, None
        for depth in range(1, forest.depth + 1):
            count = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            sized = written(frontier.join(count, "node"), "nodes", rows=n)
            small.append(sized.where(F.col("n") <= LEAF).select("node", "class"))
            big = sized.where(F.col("n") > LEAF)
            n = big.count()
            if forest.depth > DEPTH:  # clusters of a deeper forest are compared as soon as they are small enough
                big = written(self.open(big), "open", rows=n)
                of = Window.partitionBy("node")  # CLUSTER rows at most
                near = big.where(F.col("n") <= CLUSTER).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("node", "comp")))
                near = near.withColumn("outside", F.col("comp") != F.max_by("comp", F.struct("k", "comp")).over(of))
                near = near.withColumn("n_outside", F.sum(F.col("outside").cast("long")).over(of))
                small.append(cells(near.select(F.col("node").alias("main"), "class", "outside", "n", "n_outside")))
                big = big.where(F.col("n") > CLUSTER).drop("comp")
                n = big.count()
            if not n:
                self.compare(reduce(DataFrame.unionByName, small))
                return None
            if depth < forest.depth:
                frontier = branched(big.select("node", "class").join(self.classes, "class").select("node", "class", "sig"), self.threshold, forest)
        self.compare(reduce(DataFrame.unionByName, [*small, chunked(big)]), big)
        return written(self.open(big), "open", rows=n)

    def run(self) -> DataFrame | None:
        """(node, root) of every class that has a link; None if none has."""
        members, depth = self.classes, DEPTH
        while True:
            left = self.grow(members.select("class", "sig"), forest_for(self.threshold, depth))
            if left is None or left.isEmpty():
                return self.roots
            clusters = written(around(left.select("node", "class", "comp")), "clusters", rows=left.count())
            depth *= 2
            self.compare(cells(clusters.where(F.col("n") <= CLUSTER) if depth <= DEEPEST else clusters))
            larger = clusters.where(F.col("n") > CLUSTER).select("class").distinct()
            if depth > DEEPEST or larger.isEmpty():
                return self.roots
            members = written(self.classes.join(larger, "class"), "members")


# --- the operator --------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text), and its text's ``key`` and ``class``.

    Two documents are linked if ``share[1]`` times their common shingles are at least ``share[0]`` times all of theirs.
    """
    every = written(features(docs, width), "features")
    linkable = every.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    one = F.min_by(F.struct("doc_id", "key", F.col("n_shingles").alias("size"), "sig"), F.struct("doc_id", "key")).alias("one")
    classes = written(linkable.groupBy("class").agg(one).select("class", "one.*"), "classes")
    path = new_path(docs.sparkSession, "components")
    with passing(docs.sparkSession, path):  # nodes, groups, sets and links are no longer needed then
        join = Join(docs, classes, width, share)
        join.run()
        of_class = written(join.with_comp(classes.select("class", F.col("doc_id").alias("first"))), "components", path, classes.count())
    of_class = of_class.join(of_class.groupBy("comp").agg(F.min("first").alias("component")), "comp").select("class", "component")
    joined = every.drop("sig").join(of_class, "class", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component: Column = F.when(F.col("doc_id").isNotNull(), own)
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "key", "class")


def sketch_of(classes: DataFrame) -> DataFrame:
    """(class, size, sketch): the size of each set, and the low byte of each coordinate of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("size"), pa.array([r.tobytes() for r in sig], pa.binary())], ["class", "size", "sketch"])

    return classes.select("class", "size", "sig").mapInArrow(run, "class long, size long, sketch binary")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, share=(85, 100)).drop("key", "class")


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLE_SQL = {
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v WHERE r.c < l.b),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept FROM s JOIN m ON m.v = s.doc_id"""
}
