"""Every registered query with SQL equals it; the others give rows. The entry works without the optional folders."""

import duckdb
import pytest

from tests.conftest import SF
from tidewater import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def con():
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    if name not in registry.oracle_sql():
        assert rows
        return
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    mine = sorted((tuple(_norm(r[c]) for c in columns) for r in rows), key=repr)
    theirs = sorted((tuple(_norm(row[i]) for i in at) for row in want.fetchall()), key=repr)
    assert mine == theirs


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(NAMES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry._optional("tidewater.nothing_of_this_name") is None
