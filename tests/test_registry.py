"""Registered queries against their SQL on the smallest tables, and what their plans hold."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, same
from tidewire.registry import base

FOLDER = "/root/testdata/sf0.001"
# Covered by the model tests at length, and slow to repeat here.
HEAVY = ("DED1", "DED2", "DED3_p", "DED5", "DED7", "STR", "UDF3", "SNK8", "SNK2_story_stream")
LIGHT = [q for q in entry.oracle_sql() if not q.startswith(HEAVY)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


def sort_key(row):
    return tuple((v is None, str(round(v, 6) if isinstance(v, float) else v)) for v in row)


@pytest.mark.parametrize("name", LIGHT)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(cursor.fetchall(), key=sort_key)
    got = sorted((tuple(r[n] for n in names) for r in df.collect()), key=sort_key)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))


def test_every_query_has_sql():
    own = {q for q in entry.queries() if q in base.QUERIES}
    assert own == set(base.ORACLES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_limits_reach_both_sides_of_the_shuffle(spark):
    plan = entry.queries()["WIN3_last_n_log"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["FLT9_positive_best"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan
