import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from paytrail import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Run in other tests already, with minutes of joins between them.
SLOW = {"detect_all", "detect_all_raw", "reconcile", "recall_by_pattern", "recall_summary", "alert_volume"}


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.oracle_sql():
        assert df.columns
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(w[i]) for i in at) for w in want.fetchall()), key=str)


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "evidence" in out.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
