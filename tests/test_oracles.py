"""Each core query against its SQL, on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quillspark.plans.queries import oracle_sql, queries


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def tables(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, small, tables, name):
    found = queries()[name](spark, small)
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    expected = tables.sql(oracle_sql()[name])
    assert sorted(expected.columns) == columns
    at = [expected.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    spark.catalog.clearCache()


def test_queries_without_sql_run(spark, small):
    for name in set(queries()) - set(oracle_sql()):
        assert queries()[name](spark, small).count() >= 0
