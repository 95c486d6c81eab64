"""Every registered graph query against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from palimpsest.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    expected = sql.sql(ORACLES[name])
    order = [expected.columns.index(c) for c in df.columns]
    assert len(order) == len(expected.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in expected.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert contract.oracle_sql().keys() <= contract.queries().keys()
