"""Every query against its SQL at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def table(t):
    names = sorted(t.column_names)
    return names, sorted(repr(r) for r in zip(*[t[c].to_pylist() for c in names]))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    if name in SQL:
        assert table(got) == table(con.sql(SQL[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
