"""Every registered query against its DuckDB twin, on whole tables."""

from __future__ import annotations

import duckdb
import pytest
from conftest import TESTDATA

import __spark_entry__ as entry_points
from check_oracle import TABLES, compare

FOLDER = f"{TESTDATA}/sf0.01"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_twin_belongs_to_a_query():
    assert set(SQL) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_duckdb(spark, con, name):
    agrees, note = compare(spark, con, name, FOLDER)
    assert agrees, note


def test_entry(spark):
    assert entry_points.entry(spark).count() == 24
