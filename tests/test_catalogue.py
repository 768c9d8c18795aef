"""Every registered recording query runs, and those with SQL agree with DuckDB."""

import math

import duckdb
import pytest

from voltra import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("embeddings", "events", "nation"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows
    if sql := catalogue.oracle_sql().get(name):
        want = db.sql(sql)
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert rows == sorted((tuple(_plain(float(r[i]) if hasattr(r[i], "quantize") else r[i]) for i in at) for r in want.fetchall()), key=repr)
