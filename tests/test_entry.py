"""The driver contract on the smallest tables, where they exist."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and len(found) >= 80
    for n in (1, 2, 6, 7):
        assert any(q.startswith(f"p{n}_") for q in found)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p7_rolling", "d1_window_counts", "c9_asof_backward", "d24_roc_auc"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from verify import cell

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    res = con.execute(entry.oracle_sql()[name])
    order = [[x[0] for x in res.description].index(c) for c in cols]
    want = sorted((tuple(cell(r[i]) for i in order) for r in res.fetchall()), key=repr)
    assert sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr) == want
