"""Every query with SQL gives the same rows in both engines."""

import duckdb
import pytest

from strandlab.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert len(got) == len(want)
    assert sum(a != b for a, b in zip(got, want)) == 0, next((a, b) for a, b in zip(got, want) if a != b)


def test_entry_without_training_data_operators():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
