"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

from steadfold.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return str(value) if value is not None else "null"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    assert rows
    if name in SQL:
        expected = duck.sql(SQL[name])
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows_of(found.columns, rows) == rows_of(expected.columns, expected.fetchall())
