"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from grapnel import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    relation = duck.sql(catalog.ORACLES[name])
    names = list(relation.columns)
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in relation.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert got == want


def test_entry_and_contract(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
