"""Every query against its SQL on the smallest test data, and the plans that have to hold at scale."""

import os
import re

import pytest

import __spark_entry__ as entry_module
from runledger.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "orders", "lineitem", "events", "documents", "part", "supplier"]
QUERIES, SQL = catalog.QUERIES, catalog.sql_texts()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cursor.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_is_cut_before_the_shuffle(spark):
    text = plan(QUERIES["newest_flow_summaries"](spark, DATA))
    assert text.count("WindowGroupLimit") == 2


def test_lookups_push_their_filter_to_the_scan(spark):
    text = plan(QUERIES["tasks_of_job"](spark, DATA))
    assert "ReadSchema" in text and "l_comment" not in text


def test_job_numbers_reach_the_scan(spark):
    text = plan(QUERIES["job_by_id"](spark, DATA))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderkey", text) and re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_orderkey", text)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_orderkey", plan(QUERIES["tasks_of_job"](spark, DATA)))


def test_no_cross_joins_and_no_python_in_any_batch_plan(spark):
    for name in ("flow_roll_up", "jobs_with_tasks", "daily_totals", "new_app_summaries", "storage_as_of", "job_details",
                 "pruned_files", "counters_from_text", "text_log_records", "json_log_events"):
        text = plan(QUERIES[name](spark, DATA))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "SinglePartition"):
            assert bad not in text, (name, bad)


def test_entry_lists_every_query_and_its_sql():
    assert QUERIES.keys() <= entry_module.queries().keys()
    assert SQL.keys() <= entry_module.oracle_sql().keys() <= entry_module.queries().keys()


def test_entry(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
