"""Every query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

from maskwright.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


def shown(value):
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, duck, name):
    got, want = QUERIES[name](spark, data), duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(shown(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())
