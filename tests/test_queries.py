"""Every registered query of the library against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from siltwork.plans import catalog


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def sql(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return c


def test_each_query_has_sql():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, data, sql, name):
    df = catalog.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sql.sql(catalog.oracle_sql()[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
