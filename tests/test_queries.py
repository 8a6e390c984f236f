import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from weftline.plans import catalog, pipeline  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.5f}"
        return v.isoformat() if isinstance(v, datetime.datetime) else str(v)

    return sorted(names), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    want = db.sql(catalog.oracle_sql()[name])
    assert norm(df.columns, df.collect()) == norm(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.queries()["active_conjunction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters: [") :].split("]", 1)[0]
    assert "EqualTo(is_active,true)" in pushed or "is_active" in pushed and "IsNotNull(user_id)" in pushed
    read = plan[plan.index("ReadSchema: struct<") :].split(">", 1)[0]
    assert "user_id" in read and "title" not in read and "created_at" not in read
