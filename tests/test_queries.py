"""Every registered query against its SQL counterpart, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_DIR
from credlens.plans.queries import QUERIES

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = duck.sql(ORACLE[name])
    assert columns == sorted(result.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    expected = result.select(*[f'"{c}"' for c in columns]).fetchall()

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    assert sorted(got, key=key) == sorted(expected, key=key)
    assert got


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
