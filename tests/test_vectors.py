"""Vectors, clusters, quality, terms, against numpy."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscope.functions import vector as V
from corpuscope.operators import fcm, knn, quality, terms
from corpuscope.operators.encoder import HashingEncoder, ModelEncoder, embed
from corpuscope.operators.pca import CenteredPCA
from corpuscope.plans import catalog

RNG = np.random.default_rng(5)
X = RNG.normal(size=(90, 6))
X[:30] += 4
X[30:60] -= 4
UNIT = X / np.linalg.norm(X, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def unit(spark):
    return spark.createDataFrame([(i, [float(v) for v in x], i % 3) for i, x in enumerate(UNIT)], "item_id long, vec array<double>, label int").repartition(3).cache()


def test_vector_functions(spark):
    row = spark.range(1).select(
        V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), V.l2_normalize(F.array(F.lit(0.0))).alias("z"), V.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("a"),
        V.top_positions(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), 2).alias("t"),
    ).first()
    assert (row.u, row.z, row.a, [(x.cluster, x.p) for x in row.t]) == ([0.6, 0.8], [0.0], 1, [(1, 0.4), (2, 0.4)])


@pytest.mark.parametrize("block", [2048, 7])
def test_knn_batch(unit, block):
    queries = unit.where("item_id % 4 = 0").select(F.col("item_id").alias("query_id"), "vec")
    got = {}
    for r in knn.block_top(queries, unit, 5, block=block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.item_id
    for q, found in got.items():
        want = sorted(range(90), key=lambda i: (-(UNIT[i] @ UNIT[q]), i))[:5]
        assert [found[k] for k in range(1, 6)] == want
    assert len(got) == 23


def test_knn_of_odd_vectors_and_names(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [1.0]), ("e", [0.0, 1.0])], "item_id string, vec array<double>")
    asked = spark.createDataFrame([("x", [1.0, 0.0]), ("y", None), ("z", [1.0])], "query_id string, vec array<double>")
    got = sorted((r.query_id, r["rank"], r.item_id, r.score) for r in knn.knn_batch(rows, asked, 5).collect())
    assert got == [("x", 1, "a", 1.0), ("x", 2, "b", 1.0), ("x", 3, "e", 0.0)]


def best_of_all(e, items, q, k, pairs=None):
    """(query, item) of the k best by sorting everything."""
    score = q @ e.T if pairs is None else np.where(pairs, q @ e.T, -np.inf)
    out = []
    for i, row in enumerate(score):
        order = sorted((j for j in range(len(items)) if row[j] > -np.inf), key=lambda j: (-row[j], items[j]))
        out += [(i, items[j]) for j in order[:k]]
    return out


@pytest.mark.parametrize("k", [1, 4, 50])
@pytest.mark.parametrize("kind", ["number", "string"])
def test_best_keeps_the_best(k, kind, monkeypatch):
    """Fed tile by tile, with many ties, items that come several times, and items that are forgotten on the way."""
    monkeypatch.setattr(knn, "TILE", 64)
    monkeypatch.setattr(knn, "ROWS_AT_ONCE", 16)
    rng = np.random.default_rng(k)
    e, q = rng.integers(-1, 2, (300, 3)).astype(float), rng.integers(-1, 2, (21, 3)).astype(float)
    items = rng.permutation(300)
    items = items if kind == "number" else np.array([f"i{x}" for x in items])
    for twins in (False, True):
        best = knn.Best(len(q), k, twins=twins)
        for lo in range(0, 300, 70):
            for _ in range(2 if twins else 1):
                knn.feed(best, items[lo : lo + 70], e[lo : lo + 70], q, np.arange(len(q)))
        i, j = np.nonzero(best.ref >= 0)
        assert list(zip(i.tolist(), best.items[best.ref[i, j]].tolist(), strict=True)) == best_of_all(e, items.tolist(), q, k)


def test_a_hundred_thousand_queries_in_one_task():
    """Rows scored against 100,000 queries of 64 dimensions, with ties by the thousand, stay below a gigabyte."""
    code = (
        "import resource, numpy as np\n"
        "from corpuscope.operators import knn\n"
        "r = np.random.default_rng(1)\n"
        "q, e = r.normal(size=(100_000, 64)), r.normal(size=(2_500, 64))\n"
        "e[:1_200] = e[0]\n"
        "best = knn.Best(len(q), 10)\n"
        "knn.feed(best, np.arange(len(e)), e, q, np.arange(len(q)))\n"
        "assert (np.sort(q[:50] @ e.T, axis=1)[:, ::-1][:, :10] - best.score[:50] < 1e-9).all() and (best.ref >= 0).all()\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1000)"
    )
    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True)
    assert float(out.stdout.split()[-1]) < 1000


def files_read(df):
    """Files that the scan of a plain read has opened, from its metrics."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_registered_index_finds_its_neighbours(spark):
    """As registered, against the exact search."""
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test data")
    rows = catalog.vectors(spark, folder).select(F.col("id").alias("item_id"), "vec")
    exact = {(r.query_id, r.item_id) for r in knn.knn_batch(rows, rows.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), 10).collect()}
    got = {(r.query_id, r.item_id) for r in catalog.QUERIES["ivf_knn"](spark, folder).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_ivf(spark, unit, tmp_path):
    """Every row is in one list; recall grows with the probes to that of the exact search, and few lists are few files."""
    index = knn.IvfIndex(n_lists=9, rounds=4).fit(unit)
    queries = unit.where("item_id % 5 = 0").select(F.col("item_id").alias("query_id"), "vec")
    stored = index.store(unit, f"file://{tmp_path}/lists")
    assert sorted(r.item_id for r in stored.read().collect()) == list(range(90))
    assert index.recall(unit, stored, queries, 3, probes=9) == 1.0 and 0.9 <= index.recall(unit, stored, queries, 3, probes=5) <= 1.0
    exact = sorted(map(tuple, knn.knn_batch(unit, queries, 3).collect()))
    got = sorted(map(tuple, index.search(stored, queries, 3, 9).collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in exact] and np.allclose([r[2] for r in got], [r[2] for r in exact])
    some, every = stored.read([0, 3]), stored.read()
    assert {r.list for r in some.select("list").distinct().collect()} == {0, 3} and 0 < files_read(some) < files_read(every)
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, list(map(float, UNIT[0])))], "query_id long, vec array<double>")
    assert {r.query_id for r in index.search(stored, odd, 3, 9).collect()} == {3}
    assert index.search(stored, odd.limit(0), 3).count() == 0
    empty = knn.IvfIndex(n_lists=3).fit(unit.limit(0))
    assert empty.search(empty.store(unit.limit(0), f"file://{tmp_path}/none"), queries, 3).count() == 0


def test_rows_in_several_lists(spark, tmp_path):
    """A row in several of a query's lists counts once; a version that is written again replaces itself."""
    stored = knn.ListStore(spark, f"file://{tmp_path}/lists")
    long = [(c, i, [float(x) for x in UNIT[i]]) for i in range(30) for c in range(4) if i % (c + 1) == 0]
    rows = spark.createDataFrame(long, "list int, item_id long, vec array<double>")
    stored.write(rows, 1)
    stored.write(rows, 1)
    stored.write(rows.withColumn("item_id", F.col("item_id") + 100), 2)
    asked = spark.createDataFrame([(i, [float(x) for x in UNIT[i]], [c, (c + 1) % 4]) for i, c in ((0, 0), (40, 1), (50, 2))], "query_id long, vec array<double>, lists array<int>")
    for block in (None, 1):
        got = {(r.query_id, r["rank"]): r.item_id for r in stored.search(asked, 4, before=2, block=block).collect()}
        for i, c in ((0, 0), (40, 1), (50, 2)):
            inside = [j for j in range(30) if j % (c + 1) == 0 or j % ((c + 1) % 4 + 1) == 0]
            want = sorted(inside, key=lambda j: (-(UNIT[j] @ UNIT[i]), j))[:4]
            assert [got[i, r] for r in range(1, 5)] == want
    assert max(r.item_id for r in stored.search(asked, 60).collect()) >= 100


def test_linear_silhouettes(spark):
    labels = [0] * 30 + [1] * 30 + [2] * 29 + [9]
    rows = spark.createDataFrame([(i, [float(v) for v in X[i]], labels[i]) for i in range(90)] + [(100, None, 0), (101, [0.0] * 6, None)], "id long, vec array<double>, cluster int")
    got = {r.id: r.silhouette for r in quality.linear_silhouettes(rows.repartition(4)).collect()}
    d, at = ((X[:, None] - X[None]) ** 2).sum(2), np.array(labels)
    for i in range(90):
        own, others = (at == at[i]) & (np.arange(90) != i), [d[i, at == c].mean() for c in set(labels) if c != at[i]]
        a = d[i, own].mean() if own.any() else 0
        assert np.isclose(got[i], (min(others) - a) / max(a, min(others)) if own.any() else 0.0)
    assert len(got) == 90 and quality.linear_silhouettes(rows.limit(0)).count() == 0
    assert {r.silhouette for r in quality.linear_silhouettes(rows.where("cluster = 1")).collect()} == {0.0}


def test_masked_scores():
    e, q = RNG.normal(size=(40, 5)), RNG.normal(size=(30, 5))
    for share in (0.1, 0.9):
        has, wants = (RNG.random((40, 7)) < share).astype(np.float32), (RNG.random((30, 7)) < share).astype(np.float32)
        assert np.allclose(np.where(has @ wants.T > 0, e @ q.T, -1e9), np.maximum(knn._scores(e, q, has, wants), -1e9))


def test_knn_ties_and_filters(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0], "a" if i % 2 else "b") for i in range(8)], "item_id long, vec array<double>, kind string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    assert sorted(r.item_id for r in knn.knn_batch(rows, q, 3).collect()) == [0, 1, 2]
    assert sorted(r.item_id for r in knn.knn_batch(rows, q, 2, {"$and": [{"kind": "a"}, {"item_id": {"$gt": 1, "$nin": [3]}}]}).collect()) == [5, 7]
    assert [r.item_id for r in knn.knn_single(rows, [1.0, 0.0], 2, "item_id", "vec", {"kind": {"$ne": "b"}}).collect()] == [1, 3]
    assert knn.knn_batch(rows, q.limit(0), 3).count() == 0 and knn.knn_batch(rows.limit(0), q, 3).count() == 0
    with pytest.raises(ValueError):
        knn.knn_batch(rows, q, 0)
    with pytest.raises(ValueError):
        knn.predicate({"a": {"$like": 1}})


def twin(x, u, m, rounds, tol, power):
    for t in range(rounds):
        w = u**m
        c = w.T @ x / w.sum(0)[:, None]
        d = np.maximum(((x[:, None] - c[None]) ** 2).sum(2), np.finfo(float).eps)
        new = 1 / ((d[:, :, None] / d[:, None, :]) ** power).sum(2)
        delta, u = np.abs(new - u).max(), new
        if delta < tol:
            break
    return c, u, t + 1, (u**m * ((x[:, None] - c[None]) ** 2).sum(2)).sum()


@pytest.mark.parametrize("kind,power", [("squared", 2.0), ("standard", 1.0)])
def test_fcm_matches_numpy(spark, rows, kind, power):
    u0 = fcm.dirichlet_start(len(X), 3)
    start = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(u0)], "id long, memberships array<double>")
    model = fcm.FuzzyCMeans(k=3, max_iter=40, tol=1e-6, kind=kind).fit(rows.join(start, "id"))
    c, u, n, inertia = twin(X, u0, 2.0, 40, 1e-6, power)
    assert model.iterations == n and np.allclose(model.centers, c) and np.isclose(model.inertia, inertia)
    got = np.array([r.memberships for r in model.transform(rows).orderBy("id").collect()])
    assert np.allclose(got, u) and np.allclose(got.sum(1), 1)


def test_fcm_hash_start_save_and_sweep(spark, rows, tmp_path):
    model = fcm.FuzzyCMeans(k=3, m=1.5, max_iter=20).fit(rows)
    labels = [r.dominant_cluster for r in model.predict(rows).orderBy("id").collect()]
    assert len(set(labels[:30])) == 1 and len(set(labels[30:60])) == 1 and labels[0] != labels[30]
    model.save(spark, f"file://{tmp_path}/m")
    again = fcm.FuzzyCMeans.load(spark, f"file://{tmp_path}/m")
    assert np.allclose(again.centers, model.centers) and again.k == 3 and again.inertia == model.inertia
    sweep = quality.k_sweep(rows, (2, 3), max_iter=5, m=1.5).collect()
    assert [r.k for r in sweep] == [2, 3] and sum(r.best for r in sweep) == 1
    with pytest.raises(ValueError):
        fcm.exponent_of(1.0)


def test_pca(spark, rows, tmp_path):
    model = CenteredPCA(2).fit(rows)
    got = np.array([r.reduced for r in model.transform(rows).orderBy("id").collect()])
    _, s, vt = np.linalg.svd(X - X.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((X - X.mean(0)) @ vt[:2].T)) and np.allclose(got.mean(0), 0)
    assert np.allclose(model.explained, (s**2 / (s**2).sum())[:2])
    model.save(spark, f"file://{tmp_path}/p")
    assert np.allclose(CenteredPCA.load(spark, f"file://{tmp_path}/p").components, model.components)


def test_silhouette(spark):
    x, y = X[:40], np.arange(40) % 3
    y[0] = 7  # a cluster of one row
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(40):
        same = (y == y[i]) & (np.arange(40) != i)
        b = min(d[i][y == c].mean() for c in set(y) - {y[i]})
        want.append(0.0 if not same.any() else (b - d[i][same].mean()) / max(b, d[i][same].mean()))
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i])) for i in range(40)], "id long, vec array<double>, cluster int")
    got = quality.silhouette(rows).first()
    assert np.isclose(got.silhouette, np.mean(want)) and got.n == 40
    assert quality.silhouette(rows, sample=10).first().n == 10
    assert quality.silhouette(rows.limit(0)).first().silhouette is None


def test_silhouettes_of_more_rows_than_a_sample(spark, tmp_path):
    """The queries score all rows, as their SQL does, copies and clusters of one row among them."""
    v = np.round(RNG.normal(size=(5_200, 4)), 3)
    v[100:400] = v[100]
    label = np.arange(len(v)) % 3
    label[7] = 9
    e = [(i, [float(x) for x in r], int(c)) for i, (r, c) in enumerate(zip(v, label, strict=True))]
    spark.createDataFrame(e, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("silhouette", "k_sweep"):
        got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(db.sql(catalog.ORACLE_SQL[name]).fetchall()), name
    assert got[0][0] == 3 and catalog.QUERIES["silhouette"](spark, str(tmp_path)).first().n == 5_200


def test_distance_sums_in_tiles_and_blocks(spark, monkeypatch):
    x = np.concatenate([X + 100, X[:5] + 100])  # far from 0, with copies
    starts = np.array([0, 10, 11, 60])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    rows = spark.createDataFrame([(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)], "id long, vec array<double>, cluster int")
    whole = {r.id: r.silhouette for r in quality.silhouettes(rows).collect()}
    monkeypatch.setattr(quality, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(quality, "POINTS_AT_ONCE", 13)
    got = quality.distance_sums(x, starts, x)
    assert np.allclose(got, np.add.reduceat(d, starts, axis=1), rtol=1e-12)
    assert quality.distance_sums(x[:1], np.array([0]), x[90:91])[0, 0] == 0
    monkeypatch.setattr(quality, "BLOCK_BYTES", 500)  # ten blocks, of which some may be empty
    parts = {r.id: r.silhouette for r in quality.silhouettes(rows, sample=None).collect()}
    assert parts.keys() == whole.keys() and all(np.isclose(parts[i], s, rtol=1e-9) for i, s in whole.items())


def test_terms(spark):
    docs = spark.createDataFrame([(i, f"Alpha beta {'gamma' if i % 2 else ''} the {'rare' * (i == 0)}") for i in range(6)] + [(9, None)], "id long, text string")
    w = terms.tfidf(docs, stop_words=["the"])
    assert {r.term for r in w.collect()} == {"alpha", "beta", "gamma"}
    norms = w.groupBy("id").agg(F.sum(F.col("tfidf") * F.col("tfidf")).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)
    members = docs.select("id", F.array(F.lit(0.25), F.lit(0.75)).alias("memberships"))
    top = terms.top_terms(w, members, 2, 1).collect()
    assert {(r.cluster, r.term) for r in top} == {(0, "alpha"), (1, "alpha")}


def test_encoders(spark):
    class Model:  # here, so that it travels to the workers with the function
        def encode(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([("a b a",), ("A b a",), ("",), (None,)], "text string")
    got = [r.embedding for r in embed(docs, HashingEncoder(16)).collect()]
    assert got[0] == got[1] and abs(np.linalg.norm(got[0]) - 1) < 1e-9 and not any(got[2]) and not any(got[3])
    h = [r[0] for r in spark.createDataFrame([("a",), ("b",)], "t string").select(F.xxhash64("t")).collect()]
    want = np.zeros(16)
    for x, times in zip(h, (2, 1), strict=True):
        want[x % 16] += times if x >= 0 else -times
    assert np.allclose(got[0], want / np.linalg.norm(want))
    from corpuscope.operators import encoder

    made = []
    first = [encoder.loaded("one", lambda: made.append(1) or len(made)) for _ in range(3)]
    assert first == [1, 1, 1] and made == [1]
    got = [r.embedding for r in embed(docs, ModelEncoder(Model, 2)).collect()]
    assert np.allclose(got[0], np.array([5, 1]) / np.sqrt(26)) and np.allclose(got[3], [0, 1])
