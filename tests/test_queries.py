"""Every query of the engine against its SQL, on the smallest test data."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from corpuscope.plans import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return tuple(canon(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(canon(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
