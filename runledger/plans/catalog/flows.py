"""Flow queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.ids import FLOW_KEY, JOB_KEY, is_job
from ...operators import flows as O, jobs as J
from ..views import Views
from .registry import MEASURES, flows_sql, query

APP = ("AMERICA", "BUILDING", "2-HIGH")
JOB = "job_1_0007"
WINDOW = (820454400000, 899251200000)  # 1996-01-01 exclusive to 1998-07-01 inclusive
JOB_COLUMNS = [*JOB_KEY, "job_id", "job_status", "version", "queue", "submit_time", "total_maps", "mb_millis"]
_JOBS = ", ".join(JOB_COLUMNS)
_KEYS = ", ".join(FLOW_KEY)


@query("flow_roll_up", "A1", "SELECT * FROM flows", "flows")
def flow_roll_up(v: Views):
    return O.roll_up(v.job_history()).drop(*O.SOLO)


@query("newest_flow_summaries", "A1 W1 W14", """
SELECT *, CAST(row_number() OVER (PARTITION BY cluster, user_name, app_id ORDER BY run_id DESC) AS BIGINT) AS flow_rank
FROM flows QUALIFY flow_rank <= 3""", "flows")
def newest_flow_summaries(v: Views):
    return O.newest_flow_summaries(v.job_history(), 3).drop(*O.SOLO)


@query("newest_flow_jobs", "W1", f"""
SELECT {_JOBS}, CAST(dense_rank() OVER (PARTITION BY cluster, user_name, app_id ORDER BY run_id DESC) AS BIGINT) AS flow_rank
FROM job_history QUALIFY flow_rank <= 3""", "job_history")
def newest_flow_jobs(v: Views):
    return O.newest_flows(v.job_history().select(*JOB_COLUMNS), 3)


@query("newest_flows_without_run", "W1", f"""
SELECT {_JOBS}, CAST(dense_rank() OVER (PARTITION BY cluster, user_name, app_id
  ORDER BY run_id DESC, CASE WHEN run_id = 0 THEN job_seq ELSE 0 END) AS BIGINT) AS flow_rank
FROM (SELECT * REPLACE (CASE WHEN version = 'P' OR submit_time > 915148800000 THEN 0 ELSE run_id END AS run_id) FROM job_history)
QUALIFY flow_rank <= 60""", "job_history")
def newest_flows_without_run(v: Views):
    unset = (F.col("version") == "P") | (F.col("submit_time") > 915148800000)
    jobs = v.job_history().withColumn("run_id", F.when(unset, F.lit(0).cast("bigint")).otherwise(F.col("run_id")))
    return O.newest_flows(jobs.select(*JOB_COLUMNS), 60)


@query("latest_flow", "W2", """
SELECT *, CAST(1 AS BIGINT) AS flow_rank FROM flows
QUALIFY row_number() OVER (PARTITION BY cluster, user_name, app_id ORDER BY run_id DESC) = 1""", "flows")
def latest_flow(v: Views):
    return O.newest_flow_summaries(v.job_history(), 1).drop(*O.SOLO)


@query("flow_counter_sums", "A2", f"""
SELECT {_KEYS}, kind, counter_group, counter_name, CAST(sum(value) AS BIGINT) AS value
FROM orders_k JOIN cells ON job_seq = l_orderkey GROUP BY ALL""", "orders_k cells")
def flow_counter_sums(v: Views):
    return O.counter_sums(v.jobs_with_counters()).drop(*O.SOLO)


@query("flow_by_run", "P3", flows_sql("(SELECT * FROM job_history WHERE cluster = 'AMERICA' AND user_name = 'BUILDING' AND app_id = '2-HIGH' AND run_id = 844128000000)"),
       "job_history")
def flow_by_run(v: Views):
    return O.roll_up(O.flow_jobs(v.job_history(), *APP, 844128000000)).drop(*O.SOLO)


@query("jobs_of_app", "P4", f"""
SELECT {_JOBS} FROM job_history WHERE cluster = 'AMERICA' AND user_name = 'BUILDING' AND app_id = '2-HIGH'""", "job_history")
def jobs_of_app(v: Views):
    return O.app_jobs(v.job_history(), *APP).select(*JOB_COLUMNS)


@query("jobs_in_run_window", "P5", f"SELECT {_JOBS} FROM job_history WHERE run_id > {WINDOW[0]} AND run_id <= {WINDOW[1]}", "job_history")
def jobs_in_run_window(v: Views):
    return O.run_window(v.job_history(), *WINDOW).select(*JOB_COLUMNS)


@query("jobs_of_version", "P6", """
SELECT job_id, version FROM (SELECT job_id, nullif(version, 'P') AS version FROM job_history)
WHERE version IS NULL OR version = 'F'""", "job_history")
def jobs_of_version(v: Views):
    jobs = v.job_history().withColumn("version", F.nullif("version", F.lit("P")))
    return O.of_version(jobs, "F").select("job_id", "version")


def _page_sql(limit: int, extra: str) -> str:
    source = f"""(SELECT * FROM job_history WHERE cluster = 'AMERICA' AND user_name = 'BUILDING' AND app_id = '2-HIGH'
      AND run_id > {WINDOW[0]} AND run_id <= {WINDOW[1]}{extra})"""
    flows = flows_sql(source)
    return f"""SELECT *, page_row > {limit} AS is_next FROM (
      SELECT *, CAST(row_number() OVER (ORDER BY run_id DESC) AS BIGINT) AS page_row FROM ({flows}))
      WHERE page_row <= {limit} + 1"""


@query("flow_stats_page", "W13 P7", _page_sql(4, ""), "job_history")
def flow_stats_page(v: Views):
    return O.flow_stats_page(v.job_history(), *APP, limit=4, start=WINDOW[0], end=WINDOW[1]).drop(*O.SOLO)


@query("flow_stats_next_page", "W13 P6 P7", _page_sql(3, " AND version = 'F' AND run_id <= 870000000000"), "job_history")
def flow_stats_next_page(v: Views):
    return O.flow_stats_page(
        v.job_history(), *APP, limit=3, version="F", start=WINDOW[0], end=WINDOW[1], start_key=(870000000000, 0, 0)
    ).drop(*O.SOLO)


@query("flow_of_job", "J1", f"""
SELECT {_JOBS} FROM job_history WHERE ({_KEYS}) IN (SELECT ({_KEYS}) FROM job_history WHERE job_id = '{JOB}')""", "job_history")
def flow_of_job(v: Views):
    return O.flow_of_job(v.job_history().select(*JOB_COLUMNS), None, JOB)


@query("jobs_with_tasks", "J2", """
SELECT cluster, user_name, app_id, run_id, o.job_id, t.task_key, t.task_type, t.task_status, t.task_finish_time, t.task_millis
FROM orders_k o LEFT JOIN tasks t ON o.job_id = t.job_id""", "orders_k tasks")
def jobs_with_tasks(v: Views):
    tasks = v.tasks_only().drop("job_epoch", "job_seq")
    jobs = v._orders().select(*FLOW_KEY, "job_id")
    return O.jobs_with_tasks(jobs, tasks, ["job_id"])


@query("job_by_id", "P1", f"SELECT job_id, {', '.join(MEASURES)} FROM job_history WHERE job_id = '{JOB}'", "job_history")
def job_by_id(v: Views):
    jobs = v.job_history()
    return jobs.filter(is_job(JOB)).select("job_id", *MEASURES)


@query("tasks_of_job", "P2", f"SELECT job_id, task_key, task_type, task_status, task_millis FROM tasks WHERE job_id = '{JOB}'", "tasks")
def tasks_of_job(v: Views):
    return J.tasks_of_job(v.tasks_only().withColumn("cluster", F.lit("c")), "c", JOB).select(
        "job_id", "task_key", "task_type", "task_status", "task_millis"
    )
