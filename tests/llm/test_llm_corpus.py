"""Near duplicates, toxicity and the pipeline, against plain Python."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.llm import components, language, mixing, neardup, packing, tokens, toxicity
from corpuscope.shared import new_path

LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().translate(bytes(LOW.get(c, c) for c in range(256))).split(None)
    if len(words) < width:
        return frozenset([b" ".join(words)]) if words else frozenset()
    return frozenset(b" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def exact(rows: list[tuple[int, str | None]], width: int, num: int) -> dict[int, int]:
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def near_copies(seed: int, groups: int, most: int, words: int = 60) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    out: list[tuple[int, str | None]] = []
    for g in range(groups):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randrange(3, words))]
        for _ in range(r.randrange(1, most)):
            new = list(base)
            for _ in range(r.randrange(0, 4)):
                new[r.randrange(len(new))] = f"X{r.randrange(9)}"
            out.append((len(out) * 3 + 1, " ".join(new)))
    return out + [(100_001, None), (100_004, ""), (100_007, " \t\n"), (100_010, "One two"), (100_013, "one\ttwo"), (100_016, "one")]


@pytest.mark.parametrize("width,num,leaf,cluster", [(3, 85, neardup.LEAF, neardup.CLUSTER), (5, 80, 16, neardup.CLUSTER), (5, 80, 16, 24)])
def test_near_duplicates(spark, monkeypatch, width, num, leaf, cluster):
    """Also with leaves so small that oversized nodes are chunked and their rest compared, in cells or a deeper forest."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "TILE", 2 * leaf)
    monkeypatch.setattr(neardup, "CLUSTER", cluster)
    monkeypatch.setattr(neardup, "DEEPEST", 4)
    monkeypatch.setattr(neardup, "SET_TOKENS", 1 << 21 if leaf > 16 else 600)
    rows = near_copies(3, 12, 40)
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame, width, (num, 100)).collect()}
    want = exact(rows, width, num)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingles(dict(rows)[i], width)) for i, r in got.items())


def test_group_larger_than_a_leaf(spark):
    """One group of near copies several times as large as a leaf; about half of it lies outside the largest component."""
    r = random.Random(5)
    base, rows = [f"w{r.randrange(9000)}" for _ in range(100)], []
    for i in range(4 * neardup.LEAF):
        new = list(base)
        for _ in range(r.randrange(1, 5)):
            new[r.randrange(100)] = f"X{r.randrange(10**6)}"
        rows.append((i, " ".join(new)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, (85, 100)).collect()}
    sets = [shingles(t, 3) for _, t in rows]
    code = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    both = neardup.shared_counts([np.array(sorted(code[x] for x in s), np.uint64) for s in sets])
    for i, j in ((0, 1), (3, 900), (17, 4 * neardup.LEAF - 1)):
        assert both[i, j] == len(sets[i] & sets[j])
    size = np.array([len(s) for s in sets])
    want = neardup.parts_of(100 * both >= 85 * (size[:, None] + size - both)).tolist()
    assert len(set(want)) > 300 and got == dict(enumerate(want))


@pytest.mark.parametrize("share", [85, 86, 88])
def test_recall_of_the_trees(share):
    """Pairs just at the threshold meet in a small node of some tree; sketches let them pass."""
    r = np.random.default_rng(share)
    forest, threshold = neardup.forest_for(0.85, neardup.DEPTH), 0.85
    assert forest.trees * forest.pool <= neardup.COORDINATES and neardup.missed(0.85, forest) <= neardup.MISS
    floor_ = int(neardup.COORDINATES * (threshold - neardup.SLACK * (threshold * (1 - threshold) / neardup.COORDINATES) ** 0.5))
    n, missed = 2000, 0
    for _ in range(n):
        size = int(r.integers(60, 400))
        own = round(size * (1 - share / 100) / (1 + share / 100))
        common, a, b = (r.integers(0, 1 << 63, k).astype(np.uint64) for k in (size - own, own, own))
        x, y = (neardup.signature(np.unique(np.concatenate([common, o]))) for o in (a, b))
        same, node = x == y, forest.roots()
        for _ in range(forest.depth):
            row, at = forest.drawn(node, threshold)
            go = same[at]
            node = (neardup.mix64(neardup.mix64(node[row] + neardup._A[at]) ^ x[at]) & ~neardup.LOW | node[row] & neardup.LOW)[go]
        met = len(node) > 0 and int((x[: neardup.COORDINATES].astype(np.uint8) == y[: neardup.COORDINATES].astype(np.uint8)).sum()) >= floor_
        missed += not met
    assert missed <= 6  # 0.001 by the trees and less by the sketches, of 2000


def test_near_duplicates_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (2, "a b c d"), (2, "a b c d"), (1, "A B c d")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(frame, 3).collect()), key=str)
    assert got == [(0, None, True), (0, None, True), (1, 1, True), (2, 1, False), (2, 1, False)]
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_shingles_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(500))
    whole = [s.tolist() for s in neardup.Shingler(3).sets([text, "a", text[:50]])]
    monkeypatch.setattr(neardup, "PIECE", 64)
    assert [s.tolist() for s in neardup.Shingler(3).sets([text, "a", text[:50]])] == whole
    assert len(whole[0]) == len(shingles(text, 3))


@pytest.mark.parametrize("hub", [components.HUB_ROWS, 20])
def test_components(spark, monkeypatch, hub):
    """In one shuffle a step, and with the rows of hubs salted."""
    monkeypatch.setattr(components, "HUB_ROWS", hub)
    monkeypatch.setattr(components, "MAX_HUBS", 1000 if hub > 20 else 40)
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def labelled(n: int = 600):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('klmnp')}{r.choice('aeiou')}" for _ in range(r.randrange(20, 60))]
        if bad:
            for w in ("stupid", "moron", "idiot"):
                words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        if i % 3 != 1:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([*rows, (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (None, "stupid moron idiot", "en", "s", 0)], "doc_id long, text string, lang string, source string, label int")
    truth = spark.createDataFrame([*labels, (0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, truth)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and all((got[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held)
    assert got[9001] == got[9002] < 0.3 < got[None]
    flipped = truth.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.learn(docs, flipped)  # held-out labels teach nothing
    assert np.array_equal(same.weight, model.weight) and same.intercept == model.intercept
    none = toxicity.learn(docs, truth.limit(0))
    assert {r.score < 1e-9 for r in toxicity.score(docs, none).collect()} == {True}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ngrams_and_pieces(monkeypatch):
    own, bucket = toxicity.ngrams(["abcd", "x"])
    assert np.bincount(own).tolist() == [4 + 3 + 2, 1]
    assert len(set(bucket.tolist())) == 10
    text = "Alpha beta; gamma delta " * 20
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert toxicity.words_of(text) == {"alpha", "beta", "gamma", "delta"}


def test_pipeline(spark, tmp_path):
    """Stage by stage against a plain reading of what each decides, and as a whole."""
    import corpus_pipeline as P

    rows, labels = labelled(300)
    rows += [(1000 + k, rows[7][1], "en", "s0", 0) for k in range(4)] + [(2000, "!! 123", "en", "s1", 0), (2001, None, "en", "s1", 0), (2002, rows[8][1] + " more", "en", None, 0)]
    path = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = new_path(spark, name)
        stage(spark, now, path).write.parquet(out)
        before, now = now.collect(), spark.read.parquet(out)
        seen.append((name, before, now.collect()))
    (_, _, known), (_, _, clean), (_, _, single), (_, _, mix), (_, _, packed) = seen
    assert {r.doc_id for r in known} == {r[0] for r in rows} - {2000, 2001}
    bad = {i for i in range(300) if i % 6 == 0}
    assert {r.doc_id for r in clean} == {r.doc_id for r in known} - bad
    keep = exact([(r.doc_id, r.text) for r in clean], 5, 80)
    assert {r.doc_id for r in single} == {i for i, c in keep.items() if i == c} and 1000 not in {r.doc_id for r in single}
    assert all(set(r.asDict()) == set(P.COLUMNS) for r in (*known, *clean, *single, *mix))
    size = sum(len(r.text.split()) for r in single)
    assert abs(sum(len(r.text.split()) for r in mix) - mixing.BUDGET * size) <= 2 * len({r.source for r in single})
    e = tokens.encoder()
    assert sum(r.length for r in packed) == sum(len(e.ids(r.text)) // 4 + 1 for r in mix)
    assert len({r.sequence_id for r in packed}) <= sum(r.length for r in packed) // packing.WINDOW + 70
    assert P.run(spark, path).count() == len(packed)
    assert language.MIN_SCORE < 0.2


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Ids with several texts, no ids, empty and very long texts, ties, clashing columns; and empty tables."""
    import corpus_pipeline as P

    r = random.Random(9)
    words = lambda n: " ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('klmnp')}{r.choice('aeiou')}" for _ in range(n))
    a, b, c, long = words(60), words(60), words(60), words(9000)
    rows = [(5, a, "en", "s0", 1), (5, b, "en", "s1", 1), (2, b, "en", "s1", 1), (7, c, "en", "s0", 1), (7, c, "en", None, 1), (7, c, "en", "s0", 1), (None, a, "en", "s0", 1), (8, "", "en", "s0", 0), (8, None, None, None, None), (9, long, "en", "s2", None)]
    docs = spark.createDataFrame([(*x, "mine", 3, 4) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, `key` int, class int").repartition(3)
    got = sorted(((x.doc_id, x.text, x.source) for x in P.one_of_each_group(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, a, "s0"), (2, b, "s1"), (7, c, None), (None, a, "s0"), (8, "", "s0"), (8, None, None), (9, long, "s2")], key=str)
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 0), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    out = P.run(spark, path)
    assert {x.doc_id for x in out.collect()} == {5, 2, 7, None, 9} and out.where("doc_id = 9").count() > 1
    for name in ("documents", "labels"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{path}/none/{name}.parquet")
    assert P.run(spark, f"{path}/none").count() == 0
