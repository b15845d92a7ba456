"""Every registered query with SQL against DuckDB."""

from __future__ import annotations

from decimal import Decimal

import duckdb
import pytest

from quillstone.plans import catalog

TABLES = "events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(x):
    return float(x) if isinstance(x, Decimal) else x


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_sql(spark, data, db, name):
    df = catalog.queries()[name](spark, data)
    sql = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    names = sorted(df.columns)
    at = [sql.columns.index(c) for c in names]
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
