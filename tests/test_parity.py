"""Every query with a DuckDB statement gives the same rows; every other gives rows."""

import math
import os

import duckdb
import pytest
from floodstats.plans.registry import COMPARED, ORACLES, QUERIES, load_all

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return "null" if v is None else str(v)

    return sorted(tuple(plain(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = COMPARED[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
