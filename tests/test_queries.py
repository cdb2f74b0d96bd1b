"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from ravelin import plan_queries, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def test_both_modules_register():
    assert all(name in queries.QUERIES for name in ("column_roles", "discovered_selectors")) and plan_queries.query is queries.query


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    if name not in queries.ORACLE:
        return
    found = duck.sql(queries.ORACLE[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_the_entry_module_lists_them(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.entry(spark).columns) == 29 and os.path.basename(entry.__file__) == "__spark_entry__.py"
