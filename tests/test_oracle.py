"""Every registered query equals its DuckDB oracle on sf0.001 (rows, names, values)."""

import math

import duckdb
import pytest

import __spark_entry__ as se

SF = "/root/testdata/sf0.001"
TABLES = ["events", "pages", "orders", "lineitem", "customer", "nation", "region", "documents", "benchmark", "embeddings"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9)
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") or len(s) == 10 else s
    return v


def _rows(records, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF)
    sp = [r.asDict() for r in df.collect()]
    cur = con.execute(se.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    dk = [dict(zip(cols, r)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(cols)
    assert len(sp) == len(dk)
    keys = sorted(cols)
    assert _rows(sp, keys) == _rows(dk, keys)


def test_entry_smoke(spark):
    out = se.entry(spark)
    assert out.count() > 0
    assert out.columns[:3] == ["device_category", "user_type", "channel"]
