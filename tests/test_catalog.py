"""Every registered core query agrees with its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 8) if isinstance(v, float) else v
    return sorted([tuple(repr(clean(r[i])) for i in order) for r in rows])


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _names():
    from lodestrata.plans import catalog

    return sorted(catalog.queries())


@pytest.mark.parametrize("name", _names())
def test_query(spark, tables, name):
    from lodestrata.plans import catalog

    df = catalog.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = tables.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert _rows(df.columns, got) == _rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
