import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 90
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6)} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_queries_against_their_sql(spark):
    """All queries that have SQL, at the smallest scale, in one connection."""
    import duckdb

    from tools.compare import rows_of
    from trellisq.sources import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    queries = entry.queries()
    wrong = []
    for name, sql in entry.oracle_sql().items():
        df = queries[name](spark, SMALL)
        res = con.execute(sql)
        cols = [c[0] for c in res.description]
        if sorted(cols) != sorted(df.columns) or rows_of(df.columns, [tuple(r) for r in df.collect()]) != rows_of(cols, res.fetchall()):
            wrong.append(name)
    assert wrong == []
    assert entry.entry(spark).count() > 0
