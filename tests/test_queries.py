"""Each query of the search engine against its SQL, in DuckDB, on the same rows."""

import duckdb
import pytest

from brindle.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages", "lineitem", "orders", "part", "events", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name not in ORACLES:
        assert rows
        return
    want = db.sql(ORACLES[name])
    order = sorted(range(len(want.columns)), key=lambda k: want.columns[k])
    assert sorted(got.columns) == [want.columns[k] for k in order]
    assert rows == sorted(repr(tuple(r[k] for k in order)) for r in want.fetchall())


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
