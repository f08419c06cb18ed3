"""Every query of the index operators against DuckDB, on the given tables."""

import os

import duckdb
import pytest

from codequarry.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda rows: sorted(repr(r) for r in rows)
    assert key(tuple(r) for r in got.select(names).collect()) == key(want.fetchall())


def test_entry_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert all(isinstance(s, str) for s in entry.oracle_sql().values())
    assert entry.entry(spark).count() == 5
