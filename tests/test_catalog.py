"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import os

import pytest

from posetta import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return str(int(v)) if v == int(v) else repr(round(v, 8))
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in catalog.SQL:
        assert got
        return
    found = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
