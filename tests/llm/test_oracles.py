import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_vector_near_duplicates", "op4_max_score", "op10_ngram_join"])
def test_sql_agrees(spark, name):
    import duckdb

    from revquarry.llm import queries

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f[:-8]} as from '{DATA}/{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
