"""Every query with SQL against DuckDB on small tables."""

import glob
import os

import duckdb
import pytest

from sparkprep.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    held = duckdb.connect()
    held.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        held.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return held


def plain(x):
    if isinstance(x, float):
        return float(f"{x:.9g}") + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    wanted = tables.sql(ORACLES[name])
    names = sorted(found.columns)
    assert sorted(wanted.columns) == names
    have = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=repr)
    want = sorted((tuple(plain(r[wanted.columns.index(c)]) for c in names) for r in wanted.fetchall()), key=repr)
    assert have == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
