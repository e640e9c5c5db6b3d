"""Every volume query with SQL gives the same rows as DuckDB does."""

import math

import duckdb
import pytest

from voxelgrove.jobs.volume_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("embeddings", "events", "orders")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(rows):
    plain = [tuple(0.0 if isinstance(v, float) and (v == 0 or math.isnan(v)) else v for v in r) for r in rows]
    return sorted(plain, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    result = tables.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = ordered(tuple(r[names.index(c)] for c in cols) for r in result.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or abs(x - y) < 2e-6 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
