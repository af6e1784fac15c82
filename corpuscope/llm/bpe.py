"""Byte-level BPE by corpus-level merge replay, and its decoder (operator 11).

Merges are replayed over all distinct words of a block of texts at once, merge by merge, not word by word.  An inverted index maps each mergeable pair of
tokens, known by the rank of what it merges into, to the positions of the words where it stands.  Ranks are taken in ascending order; all
positions of a rank merge from left to right, and only the two pairs that touch the merged token are looked up again and indexed.

The corpus is worked off in blocks of ``BLOCK_CHARS``, so no text and no id is ever shuffled, a task holds a block, and a lost task does no more than
its own again.  A worker keeps the ids of at most ``KNOWN`` words of its blocks, and replays new words only.  Words that stand in many blocks can also be
replayed once for the whole corpus and given to all tasks (``common_words``); the README has figures on why the query does without.

A word of which a merge makes a pair of smaller rank than the merge itself leaves the global order (a rank file may hold such
tokens); it is replayed alone by a heap over its own pairs, smallest rank first and leftmost of equal ones, which is the rule that defines the encoding.  A word
that is a token as a whole is that token, as the public library has it.

Words are the matches of the public pattern.  It never matches across the end of a run of blanks-and-text, so texts are cut at
blanks first, and the pattern only sees each distinct piece of a block once.

Defined results: a null or empty text has no ids; strings of special tokens are ordinary text; texts and words of any length are encoded
whole; repeated rows are each encoded; an empty table gives no rows; other columns are not kept, so their names cannot clash; ids outside
the vocabulary are an error when decoding, null ids decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpuscope.llm.common import chunks, table
from corpuscope.shared import written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of the texts that a task encodes together, and bytes of the words that one replay takes.
BLOCK_CHARS, REPLAY_BYTES = 4 << 20, 1 << 20
#: Words whose ids a worker keeps, and that ``common_words`` finds; both at most so many bytes long.
KNOWN, COMMON, KNOWN_BYTES = 1 << 18, 1 << 16, 64
#: Below this character Python's letters are those of the pattern; above, versions of Unicode differ.
ALIKE = chr(0x500)
#: No rank: larger than any.
NONE = 1 << 30
#: Ranks whose positions are sorted together, and positions of a rank up to which they are merged one by one.
WINDOW_RANKS, FEW = 512, 24

# Unicode's white space, which the public pattern's \s means.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PIECE = re.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A blank with white space or the end of the text after it: texts with one are not cut at blanks.
LOOSE = re.compile(rf" [{SPACE}]| \Z")


class Vocabulary:
    """The ranks of a rank file, which are the ids, and what derives from them."""

    def __init__(self, name: str = VOCABULARY) -> None:
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(name), "rb") as f:
            self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.decimal = {r: str(r) for r in self.token}
        self.byte = [self.rank[bytes([b])] for b in range(256)]
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = regex.compile(r" ?\p{L}+").fullmatch
        self.known: dict[str, bytes] = {}
        self._index_pairs()

    def _index_pairs(self) -> None:
        """Every pair of tokens that merges, sorted: what is not among them has no rank."""
        cuts = ((self.rank.get(t[:k]), self.rank.get(t[k:]), r) for t, r in self.rank.items() for k in range(1, len(t)))
        self.pairs = {a << 32 | b: r for a, b, r in cuts if a is not None and b is not None}
        keys = np.array(sorted(self.pairs), np.int64)
        self.keys = np.append(keys, 1 << 62)
        self.ranks = np.array([*map(self.pairs.__getitem__, keys.tolist()), NONE], np.int32)
        #: the same for single bytes, by both in one number
        self.byte_pairs = np.array([self.pairs.get(a << 32 | b, NONE) for a in self.byte for b in self.byte], np.int32)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what each two tokens merge into, or ``NONE``."""
        both = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, both)
        return np.where(self.keys[at] == both, self.ranks[at], NONE)


@lru_cache(2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """One vocabulary for each worker process."""
    return Vocabulary(name)


def pieces(text: str) -> list[str]:
    """The text cut where no word of the pattern can span: before blanks, or at the ends of runs of other characters."""
    if LOOSE.search(text):
        return PIECE.findall(text)
    first, *rest = text.split(" ")
    cut = [" " + p for p in rest]
    return [first, *cut] if first else cut


def merged_alone(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one word: the pair of smallest rank merges first, the leftmost of equal ones."""
    token, n = [v.byte[b] for b in word], len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, heap = [NONE] * n, []

    def look(i: int, j: int) -> None:
        rank[i] = v.pairs.get(token[i] << 32 | token[j], NONE)
        if rank[i] != NONE:
            heapq.heappush(heap, (rank[i], i))

    for i in range(n - 1):
        look(i, i + 1)
    while heap:
        r, i = heapq.heappop(heap)
        if rank[i] != r:
            continue  # one of its two tokens is gone
        gone, left = after[i], before[i]
        end = after[i] = after[gone]
        token[i], rank[i], token[gone], rank[gone] = r, NONE, -1, NONE
        if end < n:
            before[end] = i
            look(i, end)
        if left >= 0:
            look(left, i)
    return [t for t in token if t >= 0]


class _Index:
    """The positions of every rank that is still to come.

    Ranks are worked off in windows.  Positions of later windows wait unsorted; those of the current one are sorted by rank when it
    begins, and what is added to it meanwhile is kept by rank.
    """

    def __init__(self, ranks: np.ndarray, at: np.ndarray) -> None:
        self.waiting, self.end = [(ranks, at)] if len(at) else [], 0
        self.added: dict[int, list[int]] = {}
        self.order: list[int] = []
        self.single: tuple[list[int], list[int]] = ([], [])  # ranks and positions that came one by one and wait

    def add_one(self, r: int, i: int) -> None:
        if r >= self.end:
            self.single[0].append(r)
            self.single[1].append(i)
        elif r in self.added:
            self.added[r].append(i)
        else:
            self.added[r] = [i]
            heapq.heappush(self.order, r)

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        near = ranks < self.end
        if near.any():
            for r, i in zip(ranks[near].tolist(), at[near].tolist(), strict=True):
                self.add_one(r, i)
            ranks, at = ranks[~near], at[~near]
        if len(ranks):
            self.waiting.append((ranks, at))

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """Ranks in ascending order with their positions, sorted."""
        while self.waiting or self.single[0]:
            if self.single[0]:
                self.waiting.append(tuple(np.array(x, np.int32) for x in self.single))
                self.single = ([], [])
            ranks, at = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.end = max(self.end + WINDOW_RANKS, int(ranks.min()) + 1)
            now = ranks < self.end
            self.waiting = [(ranks[~now], at[~now])] if not now.all() else []
            ranks, at = ranks[now], at[now]
            sort = np.lexsort((at, ranks))
            ranks, at = ranks[sort], at[sort]
            first = np.flatnonzero(np.diff(ranks, prepend=-1))
            spans = dict(zip(ranks[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(ranks)], strict=True), strict=True))
            self.order = list(spans)
            heapq.heapify(self.order)
            while self.order:
                r = heapq.heappop(self.order)
                lo, hi = spans.pop(r, (0, 0))
                more = self.added.pop(r, None)
                if more:
                    yield r, np.array(sorted({*at[lo:hi].tolist(), *more}), np.int32)
                elif hi:
                    yield r, at[lo:hi]


class _Words:
    """The tokens of many words as linked lists over one array of positions, and the rank of the pair that begins at each."""

    def __init__(self, words: list[bytes], v: Vocabulary) -> None:
        size = np.array([len(w) for w in words], np.int64)
        self.v, self.ends = v, size.cumsum()
        self.starts, n = self.ends - size, int(size.sum())
        raw = np.frombuffer(b"".join(words), np.uint8)
        self.token = np.array(v.byte, np.int32)[raw]
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.after[self.ends[size > 0] - 1], self.before[self.starts[size > 0]] = -1, -1  # neighbours lie in the same word
        self.rank = np.append(v.byte_pairs[raw[:-1].astype(np.uint16) << 8 | raw[1:]], np.int32(NONE))[:n]
        self.rank[self.after < 0] = NONE
        found = np.flatnonzero(self.rank != NONE).astype(np.int32)
        self.index = _Index(self.rank[found], found)
        self.astray: list[int] = []  # positions in words that leave the global order

    def merge_few(self, now: int, at: list[int]) -> None:
        """Merge the pairs at some positions, one after another."""
        token, after, before, rank = (memoryview(x) for x in (self.token, self.after, self.before, self.rank))
        look, add = self.v.pairs.get, self.index.add_one
        for i in at:
            if rank[i] != now:
                continue  # one of its two tokens is gone
            gone, left = after[i], before[i]
            end = after[gone]
            token[i], token[gone], after[i], rank[gone], rank[i] = now, -1, end, NONE, NONE
            if end >= 0:
                before[end] = i
                r = look(now << 32 | token[end], NONE)
                if r < now:
                    self.astray.append(i)
                elif r != NONE:
                    rank[i] = r
                    add(r, i)
            if left >= 0:
                r = rank[left] = look(token[left] << 32 | now, NONE)
                if r < now:
                    self.astray.append(i)
                elif r != NONE:
                    add(r, left)

    def merge_many(self, now: int, at: np.ndarray) -> None:
        """The same, all at once."""
        token, after, before, rank, merges = self.token, self.after, self.before, self.rank, self.v.merges
        at = at[rank[at] == now]  # of the others, one of the two tokens is gone
        if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():
            # of overlapping pairs the leftmost merges, so every second one of a chain
            k = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.append(False, chained), 0, k))
            at = at[(k - first) % 2 == 0]
        gone = after[at]
        end, left = after[gone], before[at]
        inner = end >= 0
        i, e = at[inner], end[inner]
        fresh = merges(np.full(len(e), now, np.int32), token[e])  # before what follows merges as well
        token[at], token[gone], rank[gone], after[at] = now, -1, NONE, end
        before[e] = i
        rank[at] = NONE
        rank[i] = merges(np.full(len(e), now, np.int32), token[e])
        j, l = at[left >= 0], left[left >= 0]
        rank[l] = merges(token[l], np.full(len(l), now, np.int32))
        for early in (i[fresh < now], i[rank[i] < now], j[rank[l] < now]):
            self.astray += early.tolist()
        both = np.concatenate([i, l])
        both = both[(rank[both] > now) & (rank[both] != NONE)]
        if len(both):
            self.index.add(rank[both], both)


def replayed(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each word, four bytes each, by replaying every merge over all of them in rank order."""
    w = _Words(words, v)
    for now, at in w.index:
        if len(at) <= FEW:
            w.merge_few(now, at.tolist())
        else:
            w.merge_many(now, at)
    live = np.flatnonzero(w.token >= 0)
    ids, cut = w.token[live].astype("<u4").tobytes(), (4 * np.searchsorted(live, np.append(w.starts, len(w.token)))).tolist()
    out = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    for k in set(np.searchsorted(w.ends, w.astray, "right").tolist()):
        out[k] = np.array(merged_alone(words[k], v), "<u4").tobytes()
    return out


def encoded_words(words: Iterable[str], v: Vocabulary) -> Iterator[tuple[str, bytes]]:
    """Each word with its ids, four bytes each; words are replayed some ``REPLAY_BYTES`` at a time."""
    held, raw, size = [], [], 0

    def flush() -> Iterator[tuple[str, bytes]]:
        yield from zip(held, replayed(raw, v), strict=True)

    for w in words:
        b = w.encode()
        whole = v.rank.get(b)
        if whole is not None:
            yield w, whole.to_bytes(4, "little")
            continue
        held.append(w)
        raw.append(b)
        size += len(b)
        if size >= REPLAY_BYTES:
            yield from flush()
            held, raw, size = [], [], 0
    yield from flush()


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows of some ``BLOCK_CHARS`` characters, with their texts."""
    for b in batches:
        texts = [t or "" for t in b.column(column).to_pylist()]
        for lo, hi in chunks(texts, BLOCK_CHARS):
            yield b.slice(lo, hi - lo), texts[lo:hi]


def _spelled(texts: list[str], v: Vocabulary, common: dict[str, bytes] | None = None) -> tuple[set[str], dict[str, list[str]]]:
    """The distinct pieces of the texts: those that are one word, of letters or ``common``, and the others with their words."""
    found: set[str] = set()
    for t in texts:
        found.update(pieces(t))
    known = found & common.keys() if common else set()
    rest = found - known if known else found
    whole = {p for p in rest if p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) and (p.isascii() or max(p) < ALIKE or v.letters(p))}
    others = {p: v.words(p) for p in rest - whole}
    return whole | known, others


def common_words(docs: DataFrame, text_col: str = "text", name: str = VOCABULARY, most: int = COMMON) -> dict[str, bytes]:
    """The words in the most blocks of the corpus, with their ids: those of two blocks or more, ``most`` of them at most.

    Words are counted once for each block before they are shuffled.  Which counts are large enough is read off a histogram with
    eight classes for each doubling, so what comes to the driver before the words themselves is some 500 rows.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for _, texts in _blocks(batches, 0):
            found, others = _spelled(texts, v)
            found.update(*others.values())
            yield pa.RecordBatch.from_arrays([pa.array([w for w in found if len(w.encode()) <= KNOWN_BYTES], pa.string())], ["word"])

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        made = list(encoded_words((w for b in batches for w in b.column(0).to_pylist()), v))  # ``most`` words at most
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.binary()))], ["word", "ids"])

    counts = docs.select(text_col).mapInArrow(words, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    classed = written(counts.select("word", F.floor(8 * F.log2("n")).alias("class")), "bpe-words")
    room, least = most, None
    for r in sorted(classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["class"]):
        room -= r.n
        if room < 0:
            break
        least = r["class"]
    if least is None:
        return {}
    got = classed.where(F.col("class") >= least).select("word").mapInArrow(replay, "word string, ids binary").toArrow()  # ``most`` rows at most
    return dict(zip(got.column("word").to_pylist(), got.column("ids").to_pylist(), strict=True))


def encode_block(texts: list[str], v: Vocabulary, common: dict[str, bytes] | None = None) -> list[bytes]:
    """Ids of each text, four bytes each: merges are replayed over the distinct words of all that are not ``common`` or known from earlier blocks."""
    if len(v.known) > KNOWN:
        v.known = {}
    if common and not v.known:
        v.known = dict(common)
    known = v.known
    words, others = _spelled(texts, v, known)
    words.update(*others.values())
    of = {w: known[w] for w in words & known.keys()}
    new = dict(encoded_words(words - known.keys(), v))
    known.update((w, ids) for w, ids in new.items() if len(w) <= KNOWN_BYTES)
    of.update(new)
    for p, ws in others.items():
        of[p] = b"".join(map(of.__getitem__, ws))
    return [b"".join(map(of.__getitem__, pieces(t))) for t in texts]


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary, common: dict[str, bytes] | None = None) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The first column of some rows with the ids of the texts in the second."""
    for rows, texts in _blocks(batches, 1):
        yield rows.column(0), encode_block(texts, v, common)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY, common: dict[str, bytes] | None = None) -> DataFrame:
    """(id, ids array<int>): every text of the frame by the ranks of a vocabulary file.

    ``common`` has words whose ids are known (``common_words``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)  # COMMON words of KNOWN_BYTES at most
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, made in _encoded(batches, vocabulary(name), shared.value):
            ends = np.cumsum([0, *(len(m) // 4 for m in made)])
            for lo, hi in _spans(ends):
                flat = pa.array(np.frombuffer(b"".join(made[lo:hi]), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array((ends[lo : hi + 1] - ends[lo]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([own.slice(lo, hi - lo), lists], ["id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _spans(ends: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with some ``most`` ids together."""
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def decode_ids(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The bytes of a sequence of ids."""
    return b"".join(map(v.token.__getitem__, ids.tolist()))


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column as views of one array; null rows are empty."""
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    gone = column.is_null().to_numpy(zero_copy_only=False)
    for k in range(len(column)):
        yield flat[at[k] : at[k]] if gone[k] else flat[at[k] : at[k + 1]]


def decode(encoded: DataFrame, ids_col: str = "ids", name: str = VOCABULARY) -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids; a column of that name is replaced.

    Bytes, not a string: any sequence of ids can be decoded, and one that ends within a character has no string.
    """

    kept = [c for c in encoded.columns if c.lower() != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for b in batches:
            made = [decode_ids(ids, v) for ids in _lists(b.column(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, "decoded"])

    rows = encoded.select(*[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("decoded", BinaryType())]))


def digest_of(ids: np.ndarray, v: Vocabulary) -> tuple[int, str, str]:
    """A row's number of ids, and SHA-256 of the decimal ids joined by commas and of the bytes they decode to."""
    row = ids.tolist()
    return len(row), hashlib.sha256(",".join(map(v.decimal.__getitem__, row)).encode()).hexdigest(), hashlib.sha256(decode_ids(ids, v)).hexdigest()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again in the task that reads it."""
    kind = docs.schema[id_col].dataType.simpleString()
    columns = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name)
        for own, made in _encoded(batches, v):
            found = [digest_of(np.frombuffer(m, "<u4"), v) for m in made]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([own, *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], columns)

    found = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_col)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as counts and digests."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op11_bpe": op11_bpe}
ORACLE_SQL: dict[str, str] = {}
