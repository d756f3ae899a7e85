"""Every registered query with a counterpart in SQL, held against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from shiftscope.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return [plain(y) for y in x] if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert found == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() == 200
