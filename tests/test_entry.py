"""The driver contract on the smallest tables: every query runs, and equals its SQL where it has one."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"find_files", "tree_size"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_registry():
    own = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}  # those have tests of their own
    assert own - set(entry.oracle_sql()) == ROWS_ONLY


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    assert rows
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(frame.columns)
        assert rows_of(frame.columns, rows) == rows_of(names, cursor.fetchall())
