"""Every registered analytics query against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from lumenscape.plans.registry import CATALOGUE


def norm(v):
    if isinstance(v, float):
        return "%.5g" % v if v == v else None
    return str(v) if v is not None and not (isinstance(v, float) and pd.isna(v)) else None


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if q.sql])
def test_query_matches_sql(spark, sf, duck, name):
    query = CATALOGUE[name]
    got = query.spark(spark, sf)
    cursor = duck.execute(query.duckdb())
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    found = [tuple(r) for r in got.collect()]
    assert found and rows(got.columns, found) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", [n for n, q in CATALOGUE.items() if not q.sql])
def test_query_without_sql_gives_rows(spark, sf, name):
    assert CATALOGUE[name].spark(spark, sf).count() > 0
