"""Every registered query with oracle SQL against DuckDB on the smallest data set."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from lodestar.plans.catalog import REGISTRY

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(cell, v)) + "]"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, duck, query, sql):
    df = query(spark, str(DATA))
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(REGISTRY.oracles))
def test_query_matches_duckdb(spark, duck, name):
    compare(spark, duck, REGISTRY.queries[name], REGISTRY.oracles[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.oracles)))
def test_query_without_oracle_has_rows(spark, name):
    assert REGISTRY.queries[name](spark, str(DATA)).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
