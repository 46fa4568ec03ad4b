import os
from collections import Counter
from decimal import Decimal

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
GENERAL = [n for m in entry.MODULES for n in m.QUERIES if ".llm." not in m.__name__]


def norm(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", GENERAL)
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    if name not in entry.oracle_sql():
        return
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"create view {file[:-8]} as select * from '{DATA}/{file}'")
    cursor = con.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert Counter(tuple(norm(r[i]) for i in at) for r in cursor.fetchall()) == rows


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
