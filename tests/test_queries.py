"""The registered queries against their SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from codescope.plans.catalog import ORACLES, QUERIES
from codescope.plans.projections import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _key(row):
    return [(v is not None, str(type(v)), v) for v in row]


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", list(QUERIES))
def test_query_equals_sql(spark, duck, key):
    df = QUERIES[key](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    found = sorted(([_cell(r[c]) for c in columns] for r in df.collect()), key=_key)
    order = [names.index(c) for c in columns]
    expected = sorted(([_cell(r[i]) for i in order] for r in result.fetchall()), key=_key)
    assert found == expected


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.n_occurrences >= 3 for r in rows)
