"""Files as a data source, deduplication across ingests, sessions as a stream, stages of pipelines, versions of tables."""

from __future__ import annotations

import gzip
import uuid

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from corpuscope.operators import cache as C
from corpuscope.operators import fcm, stages, terms
from corpuscope.operators.encoder import HashingEncoder
from corpuscope.operators.latent import LatentEncoder
from corpuscope.sources.files import ArticleReader, dropped, read_files
from corpuscope.sources.seen import SeenTexts
from corpuscope.sources.store import VectorStore
from corpuscope.streaming.replay import replay_sessions
from corpuscope.streaming.sessions import Entries, answered

RNG = np.random.default_rng(8)


def files_read(df):
    """Files that the scan of a plain read has opened, from its metrics."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()


def test_files(spark, tmp_path):
    """Texts in two encodings, line ends, compressed and damaged files, files that lie too high or too deep."""
    for name, body in {"a/1": b"one\r\ntwo\rthree", "a/2 +%": "naïve".encode("latin-1"), "b/3.gz": gzip.compress("ünï".encode()), "b/4.gz": gzip.compress(b"lost" * 500)[:30], "b/5": b"",
                       "top": b"no category", "b/deep/6": b"too deep", "c/7": "日本".encode()}.items():
        (tmp_path / "all" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "all" / name).write_bytes(body)
    for path in (f"file://{tmp_path}/all", f"{tmp_path}/all"):
        files = read_files(spark, path, batch_bytes=5000)
        got = {(r.category, r.name): (r.raw_text, r.error is not None) for r in files.collect()}
        assert got == {("a", "1"): ("one\ntwo\nthree", False), ("a", "2 +%"): ("naïve", False), ("b", "3.gz"): ("ünï", False), ("b", "4.gz"): (None, True), ("b", "5"): ("", False), ("c", "7"): ("日本", False)}
    assert sorted(tuple(r) for r in dropped(files).collect()) == [("a", 2, 0), ("b", 3, 1), ("c", 1, 0)]
    assert len(ArticleReader({"path": f"file://{tmp_path}/all", "batchBytes": 5000}).partitions()) > 2 and files.rdd.getNumPartitions() > 2
    assert read_files(spark, f"file://{tmp_path}/nothing").count() == 0
    with pytest.raises(ValueError):
        ArticleReader({}).partitions()


def test_seen_texts(spark, tmp_path):
    """Three batches are as one; a batch that runs again changes nothing; the stored side of the join is not shuffled."""
    rows = [("c%d" % (i % 3), i, f"text {i % 7}" if i % 5 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "category string, doc_id long, text string")
    name, path = f"seen_{uuid.uuid4().hex}", f"file://{tmp_path}/seen"
    seen, kept = SeenTexts(spark, name, path, buckets=8), []
    for batch in (0, 1, 2, 1):
        fresh = seen.fresh(docs.where(F.col("doc_id") % 3 == batch), batch, digest=F.md5(F.coalesce("text", F.lit(""))))
        got = sorted(map(tuple, fresh.collect()))
        seen.add(spark.createDataFrame(got, docs.schema), batch, digest=F.md5(F.coalesce("text", F.lit(""))))
        assert batch != 1 or len(kept) < 3 or got == kept[1]
        kept.append(got)
    want, known = [], set()
    for batch in range(3):
        here = {}
        for r in sorted(r for r in rows if r[1] % 3 == batch):
            here.setdefault(r[2] or "", r)
        want.append(sorted(r for t, r in here.items() if t not in known))
        known |= set(here)
    assert kept[:3] == want
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table that is not small
    try:
        plan = seen.fresh(docs, 9)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    right = plan[plan.index("FileScan") - 300 :]  # the stored side
    assert "Bucketed: true" in right and "SortMergeJoin" in plan and "Exchange" not in right
    seen.drop()
    again = SeenTexts(spark, name, path, buckets=8)  # found again by another session
    assert again.hashes().count() == 8 and again.hashes(1).count() == len(want[0])
    again.drop()


def test_entries_grow():
    e = Entries()
    x = RNG.normal(size=(300, 4))
    for k, v in enumerate(x):
        assert e.answer(v, np.array([True, False]), np.array([k % 2 == 0, True]), 1e9) == (False, None, None)
    assert e.n == 300 and np.allclose(e.vecs[:300], x)
    met = np.flatnonzero(np.arange(300) % 2 == 0)
    hit = e.answer(x[7], np.array([True, False]), np.array([True, True]), -1e9)
    assert hit[:2] == (True, int(met[(x[met] @ x[7]).argmax()])) and e.n == 300


def test_sessions_as_a_stream(spark, tmp_path):
    """Two runs of a stream, the second from the first one's state, answer as one replay of each session."""
    x = RNG.normal(size=(90, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = RNG.dirichlet([0.3] * 3, 90)
    rows = spark.createDataFrame([("abc"[min(2, i % 5)], i, x[i].tolist(), u[i].tolist()) for i in range(90)], "session string, query_id long, vec array<double>, memberships array<double>")
    want = sorted((r.session, r.query_id, r.hit, r.entry_idx, r.score and round(r.score, 9)) for r in replay_sessions(rows, 0.8).collect())
    for part in (rows.where("query_id < 50"), rows.where("query_id >= 50")):
        part.write.mode("append").parquet(f"{tmp_path}/came")
        found = answered(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/came"), f"file://{tmp_path}/out", f"file://{tmp_path}/state", 0.8)
    got = sorted((r.session, r.query_id, r.hit, r.entry_idx, r.score and round(r.score, 9)) for r in found.collect())
    assert got == want and any(r[2] for r in got if r[1] >= 50)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2


def test_stages(spark, tmp_path):
    """A pipeline as a whole, saved and loaded, against the parts by themselves; a sweep over a grid."""
    x = RNG.normal(size=(60, 5)) + np.repeat([[0.0], [6.0], [-6.0]], 20, axis=0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    pipeline = Pipeline(stages=[stages.Reduction(k=2), stages.SoftClusters(k=3, m=1.5, maxIter=15, outputCol="u")])
    pipeline.write().save(f"{tmp_path}/unfitted")
    model = Pipeline.load(f"{tmp_path}/unfitted").fit(rows)
    model.write().save(f"{tmp_path}/fitted")
    again = PipelineModel.load(f"{tmp_path}/fitted")
    first, second = ([r.u for r in m.transform(rows).orderBy("id").collect()] for m in (model, again))
    assert np.allclose(first, second) and again.stages[1].getOrDefault("m") == 1.5 and again.stages[1].uid == model.stages[1].uid
    reduced = model.stages[0].transform(rows).select("id", F.col("reduced").alias("vec"))
    alone = fcm.FuzzyCMeans(k=3, m=1.5, max_iter=15).fit(reduced)
    assert np.allclose(alone.centers, again.stages[1].fitted.centers)
    clusters = stages.SoftClusters(m=1.5, maxIter=10)
    grid = ParamGridBuilder().addGrid(clusters.k, [2, 3, 5]).build()
    made = stages.sweep(spark, rows, [stages.Reduction(k=2), clusters], grid, stages.LinearSilhouette())
    assert made[0][0] == {"k": 3} and [s for _, s in made] == sorted((s for _, s in made), reverse=True)


def test_appends_are_whole(spark, tmp_path):
    """An append is a folder of its own; one without its end mark does not count, and an update takes all parts along."""
    store = VectorStore(spark, f"file://{tmp_path}/v")
    rows = lambda *ids: spark.createDataFrame([(str(i), [1.0]) for i in ids], "doc_id string, embedding array<float>")
    store.add(rows(1))
    store.add(rows(2, 3))
    store.add(rows(4))
    assert sorted(r.doc_id for r in store.frame().collect()) == ["1", "2", "3", "4"]
    parts = sorted(p for p in (tmp_path / "v").iterdir() if "-" in p.name)
    assert len(parts) == 2
    (parts[0] / "_SUCCESS").rename(parts[0] / "_unfinished")
    lost = {"1", "2", "3", "4"} - {r.doc_id for r in store.frame().collect()}
    assert lost in ({"2", "3"}, {"4"})
    (parts[0] / "_unfinished").rename(parts[0] / "_SUCCESS")
    store.update(spark.createDataFrame([("4", 7)], "doc_id string, dominant_cluster int"))
    store.add(rows(5))
    assert {r.doc_id: r.dominant_cluster for r in store.frame().collect()} == {"1": None, "2": None, "3": None, "4": 7, "5": None}
    store.add(rows(9), "overwrite")
    assert store.count() == 1
    store.reset()
    assert store.count() == 0


def test_cache_reads_its_clusters_only(spark, tmp_path):
    """The stored lookup answers as the one over whole entries, by batch numbers too, and its scan has the probed clusters alone."""
    x, u = RNG.normal(size=(120, 4)), RNG.dirichlet([0.1] * 6, 120)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, f"q{i}", x[i].tolist(), u[i].tolist(), None) for i in range(120)], f"query_id long, query string, vec array<double>, memberships array<double>, result {C.RESULT}")
    cache = C.SemanticCache(spark, f"file://{tmp_path}/cache", 6, 0.5)
    cache.store(rows.where("query_id < 40"))
    cache.store(rows.where("query_id BETWEEN 40 AND 69"), 0)
    cache.store(rows.where("query_id BETWEEN 70 AND 89"), 1)
    asked = rows.where("query_id >= 90")
    key = lambda df: sorted((r.query_id, r.hit, r.entry_idx, r.score and round(r.score, 9)) for r in df.collect())
    for batch, n in ((None, 90), (0, 40), (1, 70)):
        assert cache.entries(batch).count() == n
        assert key(cache.lookup(asked, log=False, batch=batch)) == key(C.lookup(asked, cache.entries(batch), 0.5))
    few = asked.withColumn("memberships", F.array(*[F.lit(float(c == 2)) for c in range(6)]))
    assert key(cache.lookup(few, log=False)) == key(C.lookup(few, cache.entries(), 0.5))
    assert 0 < files_read(cache.index.read([2])) < files_read(cache.index.read())
    cache.store(rows.where("query_id = 0"), 1)  # the batch runs again with other rows
    assert cache.entries().count() == 71


def test_latent_encoder(spark, tmp_path):
    """Directions and singular values of an exact decomposition, and better neighbours of near copies than hashing finds."""
    rng = np.random.default_rng(6)
    words = [f"w{k:03d}x" for k in range(120)]
    topics = [rng.choice(words, 18, replace=False) for _ in range(12)]
    pick = lambda t, n: " ".join(rng.choice(topics[t], n))
    texts = [pick(i % 12, 25) for i in range(160)]
    copies = [pick(i % 12, 25) for i in range(160)]  # the same topic, few of the same words in the same numbers
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *copies])] + [(900, None), (901, "")], "id long, text string").repartition(3)
    encoder = LatentEncoder(10, min_df=1, stop_words=[], rounds=6).fit(docs)
    a = np.zeros((len(texts) * 2, len(encoder.vocabulary)))
    for r in terms.tfidf(docs, min_df=1, stop_words=[]).collect():
        a[r.id, encoder.vocabulary.index(r.term)] = r.tfidf
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(encoder.singular, s[:10], rtol=1e-6) and np.allclose(np.abs((encoder.directions.T @ vt[:10].T).diagonal()), 1, atol=1e-4)
    encoder.save(spark, f"file://{tmp_path}/m")
    again = LatentEncoder.load(spark, f"file://{tmp_path}/m")
    found = {}
    for name, e in (("latent", again), ("hashed", HashingEncoder(10))):
        v = {r.id: np.array(r.v) for r in docs.select("id", e(F.col("text")).alias("v")).collect()}
        if name == "latent":
            y = a @ vt[:10].T
            assert np.allclose(np.abs(np.stack([v[i] for i in range(320)])), np.abs(y / np.linalg.norm(y, axis=1, keepdims=True)), atol=1e-4)
            assert not v[900].any() and not v[901].any()
        x = np.stack([v[i] for i in range(320)])
        score = x @ x.T - 9 * np.eye(320)
        found[name] = np.mean([(np.argsort(-score[i])[:5] % 160 % 12 == i % 160 % 12).mean() for i in range(320)])
    assert found["latent"] > found["hashed"] + 0.2 and found["latent"] > 0.8
    none = LatentEncoder(4).fit(docs.limit(0))
    assert none.vocabulary == [] and none.directions.shape[0] == 0
