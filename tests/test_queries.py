"""Every registered query against its SQL statement on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in sorted(os.listdir(SF_DIR)):
        db.execute(f"create view {name[:-8]} as select * from read_parquet('{SF_DIR}/{name}')")
    return db


def test_entry(spark):
    got = entry.entry(spark)
    assert got.columns == ["account_idx", "account", "folder_idx", "folder", "n"] and got.count() > 0


def test_every_query_has_its_statement():
    assert set(all_queries()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = tables.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert len(got) == len(want)
    as_text = [f[columns].astype(str).sort_values(columns).reset_index(drop=True) for f in (got, want)]
    assert as_text[0].equals(as_text[1])
