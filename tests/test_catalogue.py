"""Every query gives what its SQL gives, at the smallest scale."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("None" if x is None or x != x else str(x) for x in r) for r in df.itertuples(index=False))


def names():
    from revquarry.plans import catalogue

    return sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from revquarry.plans import catalogue

    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
