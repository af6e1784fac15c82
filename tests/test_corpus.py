"""Reading, filtering and deduplicating a corpus; the vector table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscope.shared import drop_all, new_path, passing, shared_dir, written
from corpuscope.sources import corpus
from corpuscope.sources.store import VectorStore, rendered_metadata


@pytest.fixture
def folder(tmp_path):
    for category, name, body in [
        ("sci.b", "1", b"h\n\n" + b"alpha " * 60), ("sci.b", "2 x", b"h\n\n" + b"alpha " * 60), ("alt.a", "9", b"h\n\n" + b"alpha " * 60),
        ("alt.a", "3", b"h\r\n\r\ncaf\xe9 " + b"beta " * 60), ("alt.a", "4", "h\n\ncafé ".encode() + b"gamma " * 60), ("alt.a", "5", b"h\n\nshort"),
    ]:
        (tmp_path / category).mkdir(exist_ok=True)
        (tmp_path / category / name).write_bytes(body)
    return str(tmp_path)


def test_read_and_load(spark, folder):
    articles = corpus.read_articles(spark, folder)
    assert {(r.category, r.name) for r in articles.collect()} == {("sci.b", "1"), ("sci.b", "2 x"), ("alt.a", "9"), ("alt.a", "3"), ("alt.a", "4"), ("alt.a", "5")}
    docs = {r.doc_id: r.text for r in corpus.load_corpus(articles).collect()}
    assert set(docs) == {"alt.a/9", "alt.a/3", "alt.a/4"}  # first in order of category and name
    assert docs["alt.a/3"].startswith("café beta") and docs["alt.a/4"].startswith("café gamma")
    assert [r.category for r in corpus.categories(articles).collect()] == ["alt.a", "sci.b"]


def test_unreadable_files_are_counted(spark, folder, monkeypatch):
    assert corpus.unreadable(spark, folder) == 0
    found = corpus._files(spark, folder)

    class Lost:  # a listing that has one file more than can be read
        select = staticmethod(lambda *c: found.select(*c).unionByName(found.select(*c).limit(1)))
        where = staticmethod(found.where)

    monkeypatch.setattr(corpus, "_files", lambda *a: Lost)
    assert corpus.unreadable(spark, folder) == 1


def test_head_comes_before_filters(spark, folder):
    articles = corpus.read_articles(spark, folder)
    assert corpus.head_per_category(articles, 0).count() == 6
    assert {r.name for r in corpus.head_per_category(articles, 1).collect()} == {"3", "1"}
    assert corpus.load_corpus(articles, max_docs_per_category=1).count() == 2


def test_exact_dedup_of_nulls_and_repeats(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "x"), ("b", 0, "x"), ("a", 5, None), ("a", 4, None), ("c", 1, "y"), ("c", 1, "y")], "category string, doc_id long, text string")
    assert {(r.category, r.doc_id) for r in corpus.exact_dedup(rows).collect()} == {("a", 1), ("a", 4), ("c", 1)}
    assert corpus.exact_dedup(rows).count() == 3
    # texts under one key, and without one, are all kept
    same = spark.createDataFrame([("a", 1, "one"), ("a", 1, "two"), (None, None, "three"), (None, None, "four"), (None, None, "four")], "category string, doc_id long, text string")
    assert sorted(r.text for r in corpus.exact_dedup(same).collect()) == ["four", "one", "three", "two"]
    assert corpus.exact_dedup(rows.limit(0)).count() == 0


def test_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/vectors")
    assert store.count() == 0
    rows = spark.createDataFrame([("a", [1.0, 0.0], "t", "c"), ("b", [0.0, 1.0], "u", "d")], "doc_id string, embedding array<double>, text string, category string")
    store.add(rows)
    store.add(rows, "ignore")
    assert store.count() == 2
    with pytest.raises(ValueError):
        store.add(rows, "errorifexists")
    store.update(spark.createDataFrame([("a", 3)], "doc_id string, dominant_cluster int"))
    got = {r.doc_id: (r.dominant_cluster, r.category) for r in store.frame().collect()}
    assert got == {"a": (3, "c"), "b": (None, "d")}
    store.update(spark.createDataFrame([("a", 5), ("a", 4)], "doc_id string, dominant_cluster int"))
    assert store.count() == 2 and {r.dominant_cluster for r in store.frame().collect()} == {4, None}
    store.add(rows, "overwrite")
    assert store.count() == 2
    store.reset()
    assert store.count() == 0


def test_rendered_metadata(spark):
    row = rendered_metadata(spark.range(1).select(F.lit(1).alias("a"), F.array(F.lit(1), F.lit(2)).alias("b"))).first()
    assert (row.a, row.b) == (1, "[1,2]")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda k, d=None: d)

    class Context:
        applicationId, master = "app", "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_passing_tables(spark):
    """Tables of a block are gone at its end, but for the ones it keeps, also in blocks inside blocks."""
    drop_all(spark)
    a, b, c = (new_path(spark, x) for x in "abc")
    with passing(spark, a):
        written(spark.range(3), "a", a)
        inner = new_path(spark, "inner")
        with passing(spark, inner):
            kept = written(spark.range(4), "inner", inner)
            written(spark.range(5), "gone")
        assert kept.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(inner)
    assert spark.read.parquet(a).count() == 3 and drop_all(spark) == 3 and b != c


def test_shared_tables(spark):
    drop_all(spark)
    path = new_path(spark, "numbers")
    assert path.startswith(shared_dir(spark)) and written(spark.range(5), "numbers", path).count() == 5
    assert drop_all(spark) == 1 and drop_all(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
