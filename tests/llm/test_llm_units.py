"""Operators 11 to 13: byte pairs, filter audit, prefix trie, against plain Python, a public library and their SQL."""

from __future__ import annotations

import hashlib
import random
import re
import subprocess
import sys
import zlib
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pytest

from corpuscope.llm import audit, bpe, trie

ROOT = Path(__file__).resolve().parents[2]


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --- 11 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary().rank, special_tokens={})


def plain_ids(text: str) -> list[int]:
    v = bpe.vocabulary()
    whole, others = bpe._spelled([text], v)
    of = dict(bpe.encoded_words({*whole, *(w for ws in others.values() for w in ws)}, v))
    return [i for p in bpe.pieces(text) for w in (others[p] if p in others else [p]) for i in np.frombuffer(of[w], "<u4").tolist()]


def test_every_character_as_the_library(library):
    """A sixteenth of all code points and all of the first 4,096, with blanks, letters, digits and themselves around them."""
    for cp in (*range(0x1000), *range(0x1000, 0x110000, 16)):
        if not 0xD800 <= cp < 0xE000:
            c = chr(cp)
            text = f"a{c}b 1{c}2{c}{c} x {c} {c}y  {c} "
            assert plain_ids(text) == library.encode_ordinary(text), hex(cp)


def test_random_texts_as_the_library(library):
    r = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", " \n", "é", "日本", "1", "23", "'s", "'", "!", "İ", "\x1c", "　", "\xa0", "😀", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        assert plain_ids(text) == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("few", [0, bpe.FEW, 1 << 30])
def test_replay_is_the_rule(monkeypatch, few):
    """Replaying all words together gives what each gives alone, words that leave the global order included."""
    monkeypatch.setattr(bpe, "FEW", few)
    v, r = bpe.vocabulary(), random.Random(2)
    words = ["".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randrange(0, 25))).encode() for _ in range(20_000)]
    words += [bytes(r.randrange(256) for _ in range(r.randrange(1, 12))) for _ in range(2000)] + [b"a" * 5000, b"ab" * 3000, b"", b"x" * 70_000]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.replayed(words, v)] == [bpe.merged_alone(w, v) for w in words]
    assert bpe.replayed([], v) == []
    for w in (b"lower", b"newest", b"aaa"):  # the definition itself: the smallest rank, the leftmost of equal ones
        parts = [bytes([x]) for x in w]
        while ranked := [(v.rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in v.rank]:
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merged_alone(w, v) == [v.rank[p] for p in parts]


@pytest.mark.parametrize("few", [0, 100])
def test_words_that_leave_the_order(monkeypatch, few):
    """A made vocabulary where a merge makes a pair of smaller rank: abc before ab."""
    v = bpe.vocabulary()
    own = bpe.Vocabulary.__new__(bpe.Vocabulary)
    own.rank = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"cd": 258}
    own.token, own.byte, own.words, own.letters = {r: t for t, r in own.rank.items()}, list(range(256)), v.words, v.letters
    own._index_pairs()
    monkeypatch.setattr(bpe, "FEW", few)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.replayed([b"abcd", b"abab", b"xcd"], own)] == [[256, ord("d")], [257, 257], [ord("x"), 258]]


def test_op11(spark, tmp_path, library, monkeypatch):
    r = random.Random(4)
    texts = [None, "", " ", "a", "\n\n x", "naïve 日本語 <|endoftext|> 😀", "x" * 300_000, "日本" * 50_000, " ".join("word%d's" % r.randrange(500) for _ in range(200_000))]
    texts += [" ".join(r.choice(["alpha", "beta", "Gamma,", "delta!", "12", "3"]) for _ in range(30)) for _ in range(200)]
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)] + [(None, "no id", "kept", 1), (3, "a", "kept", 1), (3, "a", "kept", 1)]
    for folder, some in (("all", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string, ids string, decoded int").repartition(3).write.parquet(f"file://{tmp_path}/{folder}/documents.parquet")
    got = bpe.op11_bpe(spark, f"file://{tmp_path}/all").collect()
    want = [(i, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.op11_bpe(spark, f"file://{tmp_path}/none").count() == 0
    docs = spark.read.parquet(f"file://{tmp_path}/all/documents.parquet")
    common = bpe.common_words(docs)
    assert {" alpha", " beta"} <= set(common) and all(np.frombuffer(x, "<u4").tolist() == library.encode_ordinary(w) for w, x in common.items())
    for known in (None, common):
        back = bpe.decode(bpe.encode(docs, common=known)).collect()
        assert sorted((bytes(r.decoded), list(r.ids)) for r in back) == sorted(((t or "").encode(), library.encode_ordinary(t or "")) for _, t, *_ in rows)
    empty = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "i int, ids array<int>")).collect()
    assert [bytes(r.decoded) for r in empty] == [b"", b""]


def test_known_words_are_forgotten(monkeypatch, library):
    """A worker that may keep few words still encodes every block as the library does."""
    monkeypatch.setattr(bpe, "KNOWN", 50)
    v, r = bpe.Vocabulary(), random.Random(3)
    for _ in range(12):
        texts = [" ".join(r.choice("etaoin") * r.randrange(1, 6) + str(r.randrange(60)) for _ in range(40)) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_block(texts, v)] == [library.encode_ordinary(t) for t in texts]
        assert len(v.known) < 50 + 400


def test_encoding_stays_within_memory():
    """Two blocks of made-up words: a task stays far below the third of an executor that it may take."""
    code = (
        "import random, resource, pyarrow as pa\n"
        "from corpuscope.llm import bpe\n"
        "r = random.Random(1)\n"
        "v = bpe.vocabulary()\n"
        "for _ in range(2):\n"
        "    texts = [' '.join(''.join(r.choice('etaoinshrdlu') for _ in range(r.randrange(2, 10))) for _ in range(500)) for _ in range(bpe.BLOCK_CHARS // 3500)]\n"
        "    bpe.encode_block(texts, v)\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1000)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT, check=True)
    assert float(out.stdout.split()[-1]) < 600


# --- 12 ------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def audit_tables(spark, path, docs, labels):
    for name, schema, rows in (("documents", "doc_id long, text string, source string, part string, n int", docs), ("labels", "doc_id long, quality int, toxic int", labels)):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/{name}.parquet")


def plain_audit(docs, labels):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, source, *_ in docs:
        t = t or ""
        words = WORD.findall(t)
        fails = "".join(
            f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t)),
                                        i is not None and i > least[t]), strict=True) if x
        )
        rows.append((source or "", fails, any(d == i is not None and q == 1 for d, q, _ in labels), any(d == i is not None and x == 1 for d, _, x in labels)))
    out = []
    for part in {r[0] for r in rows}:
        here = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = here
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(f in r[1] for r in here) - len(gone), sum(r[1] == f for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
    shapley = {}
    for r in out:
        shapley[r[0], r[-1]] = shapley.get((r[0], r[-1]), 0) + r[4]
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def test_op12(spark, tmp_path):
    r = random.Random(5)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "Big", "a#b", "x", "y", "z"]) + str(r.randrange(200))
    docs = [(i, " ".join(word() for _ in range(r.choice([3, 150, 199, 200, 400]))), r.choice(["s1", "s2", ""]), "p", 1) for i in range(80)]
    docs += [(100 + i, docs[i % 5][1], "s1", "p", 1) for i in range(40)]  # copies
    docs += [(200, None, None, None, None), (201, "", "s2", "p", 1), (202, None, "s1", "p", 1), (None, docs[0][1], "s1", "p", 1), (None, "no id", None, "p", 1), (7, docs[7][1], "s1", "p", 1)]
    docs += [(203, "ab " * 400, "s3", "p", 1), (204, "AbC" * 40_000 + " x", "s3", "p", 1), (205, " ".join(["w"] * 300), "s3", "p", 1), (206, "a\x0bb\x0cc\td\re", "s3", "p", 1)]
    labels = [(i, int(i % 2 == 0), int(i % 3 == 0)) for i in range(100)] + [(None, 1, 1), (3, None, None), (3, 1, 0), (200, 1, 1), (999, 1, 1)]
    audit_tables(spark, f"file://{tmp_path}/all", docs, labels)
    audit_tables(spark, f"file://{tmp_path}/none", [], [])
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = sorted(tuple(x[c] for c in columns) for x in audit.op12_filter_audit(spark, f"file://{tmp_path}/all").collect())
    want = plain_audit(docs, labels)
    assert got == want and len(got) == 4 * 600
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/all/{t}.parquet/*.parquet'")
    assert sorted(db.sql(audit.SQL).select(", ".join(columns)).fetchall()) == want
    assert audit.op12_filter_audit(spark, f"file://{tmp_path}/none").count() == 0


# --- 13 ------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    turns = {c: [t for _, t in sorted(x)] for c, x in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = turns.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + own[h:]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(not any(m[: len(n)] == n and len(m) > len(n) for m in below) for n in below)
        saved = sum((len(nodes[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        ends = sorted(c for c in members if len(paths[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        out.append((min(members), len(node), parent, len(members), len(children), leaves, saved, sha(",".join(map(str, ends)).encode())))
    return out


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversations(seed: int, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in [r.randrange(-150, 700) for _ in range(n)] + [0, 100, 200]:
        for t in range(r.randrange(1, 9)):
            rows.append((c, t, r.choice(["user", "assistant", None]), r.choice(["", "a", "bé", None, "hello 😀"])))
    rows += [(300, t, "user", "long " * 4000) for t in range(3)] + [(c, 0, "user", "hello 😀") for c in range(800, 880)]
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (5, 2, "x", "tie"), (5, 2, "y", "tie"), (None, 0, "user", "lost"), (0, 0, "ab", "c"), (1, 0, "a", "bc")]
    rows += [(399, t, "user", "turn %d" % (t % 7)) for t in range(400)]  # one conversation with very many turns
    return [(*x, 1, "kept") for x in rows]


def trie_table(spark, rows, path):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, run string").repartition(3).write.parquet(f"{path}/conversations.parquet")


@pytest.mark.parametrize("seed", [1, 2])
def test_op13(spark, tmp_path, monkeypatch, seed):
    """With few rows to a run, ids to a piece and members to a hub in the second case."""
    if seed == 2:
        monkeypatch.setattr(trie, "PIECE_BITS", 3)
        monkeypatch.setattr(trie, "HUB_LEAST", 3)
        monkeypatch.setattr(trie, "HUBS", 1 << 40)
    rows = conversations(seed)
    trie_table(spark, rows, f"file://{tmp_path}/all")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13" if seed == 2 else before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(seed == 1).lower())
    try:
        got = [tuple(x[c] for c in TRIE) for x in trie.op13_prefix_trie(spark, f"file://{tmp_path}/all").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    key = lambda x: (x[0], x[1])
    assert sorted(got, key=key) == sorted(plain_trie(rows), key=key)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/all/conversations.parquet/*.parquet'")
    assert sorted(db.sql(trie.SQL).select(", ".join(TRIE)).fetchall(), key=key) == sorted(got, key=key)


def test_op13_without_conversations(spark, tmp_path):
    trie_table(spark, [], f"file://{tmp_path}/none")
    assert trie.op13_prefix_trie(spark, f"file://{tmp_path}/none").count() == 0
    trie_table(spark, [(101, 0, "user", "x", 1, "kept")], f"file://{tmp_path}/one")  # its base is absent; it may lose its only turn
    got = [tuple(x[c] for c in TRIE) for x in trie.op13_prefix_trie(spark, f"file://{tmp_path}/one").collect()]
    assert sorted(got) == sorted(plain_trie([(101, 0, "user", "x")]))
