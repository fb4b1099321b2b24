"""Every registered query against its SQL on the smallest given tables."""

import glob
import math
import os

import duckdb
import pytest

from checks import oracle
from checks.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = oracle.all_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(rows):
    def cell(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in rows), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    relation = duck.sql(SQL[name])
    columns = sorted(relation.columns)
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == columns
    want = relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)
