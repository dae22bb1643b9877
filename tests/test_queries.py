"""All queries outside the corpus operators against their SQL, and the entry points."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from siltstone import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, tables, name):
    found = registry.queries()[name](spark, SF)
    want = tables.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    mine = [tuple(r) for r in found.select(*columns).collect()]
    theirs = want.select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(str, mine)) == sorted(map(str, theirs))


def test_entry_and_registries(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
