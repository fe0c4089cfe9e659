"""Every registered query against its SQL counterpart."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from strataspark.registry.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Queries whose work is a Python reader or a per-image kernel.
PYTHON_WORKERS = {"img2_resample", "src1_sqlite_scan", "pip5_thumbnails"}
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((v is None, repr(v)) for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if name not in PYTHON_WORKERS:
        assert not [node for node in UNWANTED if node in plan]
    columns = sorted(df.columns)
    found = _sorted(tuple(r) for r in df.select(*columns).collect())
    cursor = duck.execute(entry_points.oracle_sql()[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    wanted = _sorted(tuple(row[i] for i in at) for row in cursor.fetchall())
    assert found
    assert [tuple(map(repr, r)) for r in found] == [tuple(map(repr, r)) for r in wanted]


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(QUERIES) <= set(entry_points.oracle_sql())


def test_entry_returns_rows(spark):
    df = entry_points.entry(spark)
    assert df.count() == 167
