"""Every registered query against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as registry
from conftest import DATA

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def test_every_query_has_a_counterpart():
    assert set(registry.OPERATORS) <= set(registry.oracle_sql()) & set(registry.queries())


@pytest.mark.parametrize("name", list(registry.OPERATORS))
def test_matches(spark, duck, name):
    ours = registry.queries()[name](spark, DATA)
    columns = sorted(ours.columns)
    expected = duck.sql(registry.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    place = [expected.columns.index(c) for c in columns]
    assert (sorted(tuple(text(row[c]) for c in columns) for row in ours.collect())
            == sorted(tuple(text(row[i]) for i in place) for row in expected.fetchall()))


def test_entry(spark):
    assert registry.entry(spark).limit(1).count() == 1
