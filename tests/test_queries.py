"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidewatch.plans import detection_queries, event_queries, report_queries, text_queries, tracking_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (detection_queries, text_queries, event_queries, report_queries, tracking_queries)
CASES = [(n, f, p.ORACLE_SQL.get(n)) for p in PLANS for n, f in p.QUERIES.items()]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(float(v), 6)) if isinstance(v, float) else str(v)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query(spark, duck, name, query, sql):
    found = query(spark, DATA).toPandas()
    if sql:
        wanted = duck.sql(sql).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows(found) == rows(wanted)
