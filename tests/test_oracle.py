"""Every query with SQL is compared with DuckDB on the same files, value by value."""

import math
from pathlib import Path

import duckdb
import pytest

from holdfast.catalog import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "null" if value is None else str(value)


def _rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert want, "an empty answer proves nothing"
    assert _rows(df.columns, got) == _rows(columns, want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
