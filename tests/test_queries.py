"""Every query against DuckDB on the smallest tables, by names, values and types."""

import decimal
import glob
import os

import duckdb
import pytest

from redlake.plans import registry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, float | decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [list(rel.columns).index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for f in df.schema:
        assert TYPES[f.dataType.simpleString()] == types[f.name], f.name


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_no_python_in_checked_queries(spark):
    """What SQL can say runs without Python on the executors; streams with own state, folds in order, bytes of the store, pages and dot segments are the exceptions."""
    for name in set(registry.oracle_sql()) - {"stream_change_detect", "stream_presence", "stream_dedupe", "stream_deliver_once", "quota_admission", "throttle_notice", "page_title", "page_category", "page_links", "content_root", "fn_url_join"}:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan, name
