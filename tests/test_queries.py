import os

import duckdb
import pytest

from cadenza.plans import frames, queries, streams

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.QUERIES | frames.QUERIES | streams.QUERIES, queries.SQL | frames.SQL | streams.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert rows
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == columns
        assert rows == sorted(repr(tuple(r)) for r in found.select(*(f'"{c}"' for c in columns)).fetchall())
