"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from spindrift.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    if name in catalogue.ORACLE_SQL:
        want = sql.sql(catalogue.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    else:
        assert got
