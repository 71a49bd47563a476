"""The read functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import apps
from .. import reads as R
from ..views import Views
from .registry import (
    app_summary_sql, flows_sql, merged_sql, query,
)
from .apps import _merged_days

CLUSTER, USER, APP = "ASIA", "MACHINERY", "3-MEDIUM"
NOW = 883612800000  # 1998-01-01
NEW_NOW = 796694400000 + 43200000  # 1995-04-01 12:00
_WHERE = f"cluster = '{CLUSTER}' AND user_name = '{USER}' AND app_id = '{APP}'"


@query("read_job", "X3 P1", f"""
SELECT job_id, total_maps, queue FROM job_history WHERE cluster = '{CLUSTER}' AND job_id = 'job_1_0017'""", "job_history")
def read_job(v: Views):
    return R.job(v.job_history(), CLUSTER, "job_1_0017").select("job_id", "total_maps", "queue")


@query("read_tasks", "X3 P2", "SELECT job_id, task_key, task_millis FROM tasks WHERE job_id = 'job_1_0012'", "tasks")
def read_tasks(v: Views):
    return R.tasks(v.tasks_only().withColumn("cluster", F.lit("c")), "c", "job_1_0012").select("job_id", "task_key", "task_millis")


@query("read_job_flow", "X3 J1", """
SELECT job_id FROM orders_k WHERE (cluster, user_name, app_id, run_id) IN
  (SELECT (cluster, user_name, app_id, run_id) FROM orders_k WHERE job_seq = 3 AND cluster = 'AMERICA')""", "orders_k")
def read_job_flow(v: Views):
    return R.job_flow(v._orders(), "AMERICA", "job_1_0003").select("job_id")


@query("read_flow_series", "X3 P5 W1 P28", f"""
SELECT job_id, run_id, CAST(dense_rank() OVER (ORDER BY run_id DESC) AS BIGINT) AS flow_rank FROM orders_k
WHERE {_WHERE} AND run_id > {NOW - 800 * 86400000} AND run_id <= {NOW} QUALIFY flow_rank <= 2""", "orders_k")
def read_flow_series(v: Views):
    return R.flow_series(v._orders(), CLUSTER, USER, APP, 2, start=NOW - 800 * 86400000, now=NOW).select("job_id", "run_id", "flow_rank")


@query("read_flow_series_of_version", "X3 P6 P8 W1", f"""
SELECT job_id, key, value FROM (SELECT job_id, dense_rank() OVER (ORDER BY run_id DESC) AS r FROM orders_k
  WHERE {_WHERE} AND version = 'F') JOIN conf_rows USING (job_id) WHERE r <= 3 AND key = 'mapreduce.job.name'""", "conf_rows")
def read_flow_series_of_version(v: Views):
    rows = R.flow_series(v.flow_jobs_conf(), CLUSTER, USER, APP, 3, version="F", conf_keys=["mapreduce.job.name"])
    return rows.select("job_id", F.explode("conf").alias("key", "value"))


_NEWEST = f"""(SELECT *, CAST(row_number() OVER (ORDER BY run_id DESC) AS BIGINT) AS flow_rank
  FROM ({flows_sql(f"(SELECT * FROM job_history WHERE {_WHERE} AND run_id > {NOW - 800 * 86400000} AND run_id <= {NOW})")}))"""


@query("read_flow_details", "X3 P15 A1 W1 P28", f"SELECT flow_rank, {', '.join(R.FLOW_SUMMARY)} FROM {_NEWEST} WHERE flow_rank <= 4", "job_history")
def read_flow_details(v: Views):
    return R.flow_details(v.job_history(), CLUSTER, USER, APP, 4, start=NOW - 800 * 86400000, now=NOW).drop("solo_epoch", "solo_seq")


@query("read_flow_details_with_jobs", "X3 P15 J2", f"""
SELECT f.run_id, f.job_count, f.total_maps, j.job_id, j.total_maps AS job_total_maps, j.queue AS job_queue FROM {_NEWEST} f
JOIN job_history j USING (cluster, user_name, app_id, run_id) WHERE flow_rank <= 4""", "job_history")
def read_flow_details_with_jobs(v: Views):
    rows = R.flow_details(v.job_history(), CLUSTER, USER, APP, 4, start=NOW - 800 * 86400000, now=NOW, include_jobs=True)
    return rows.select("run_id", "job_count", "total_maps", "job_id", "job_total_maps", "job_queue")


@query("read_flow_details_without_run", "X3 P15", f"""
SELECT job_count, total_maps, job_id FROM (SELECT *, row_number() OVER (ORDER BY job_seq) AS k FROM
  (SELECT job_seq, job_id, total_maps, CAST(1 AS BIGINT) AS job_count FROM job_history WHERE {_WHERE})) WHERE k <= 3""", "job_history")
def read_flow_details_without_run(v: Views):
    """Jobs without a run id are flows of their own, with their own sums."""
    jobs = v.job_history().withColumn("run_id", F.lit(0).cast("bigint"))
    return R.flow_details(jobs, CLUSTER, USER, APP, 3, include_jobs=True).select("job_count", "total_maps", "job_id")


@query("read_flow_stats_with_jobs", "X3 W13 P15", f"""
SELECT run_id, f.job_count, f.mb_millis, j.job_id FROM (SELECT *, row_number() OVER (ORDER BY run_id DESC) AS r
  FROM ({flows_sql(f'(SELECT * FROM job_history WHERE {_WHERE})')})) f JOIN job_history j USING (cluster, user_name, app_id, run_id) WHERE r <= 3""", "job_history")
def read_flow_stats_with_jobs(v: Views):
    return R.flow_stats_with_jobs(v.job_history(), CLUSTER, USER, APP, 3).select("run_id", "job_count", "mb_millis", "job_id")


@query("read_flow_stats", "X3 W13 P15", f"""
SELECT {', '.join(R.FLOW_SUMMARY)}, page_row, page_row > 2 AS is_next FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY run_id DESC) AS BIGINT) AS page_row
  FROM ({flows_sql(f'(SELECT * FROM job_history WHERE {_WHERE})')})) WHERE page_row <= 3""", "job_history")
def read_flow_stats(v: Views):
    return R.flow_stats(v.job_history(), CLUSTER, USER, APP, 2).drop("solo_epoch", "solo_seq")


@query("read_app_versions", "X3 W4", f"SELECT * FROM versions WHERE {_WHERE}", "versions")
def read_app_versions(v: Views):
    return R.app_versions(v.app_version(), CLUSTER, USER, APP)


@query("read_cluster_of", "X3 J5", "SELECT r_name AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3'")
def read_cluster_of(v: Views):
    places = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return R.cluster_of(places.select(F.col("n_name").alias("host"), F.col("r_name").alias("cluster")), "NATION_3")


_STORE_NOW = 1704240000
_STORAGE = ", ".join(R.STORAGE)


@query("read_storage_snapshot", "X3 P25 J8 P28", f"""
SELECT {_STORAGE} FROM ({merged_sql('usage', "cluster = 'c1'")}) WHERE run_id =
  (SELECT max(run_id) FROM usage WHERE cluster = 'c1' AND run_id <= {_STORE_NOW - 7200})""", "usage")
def read_storage_snapshot(v: Views):
    return R.at_detail(R.storage_snapshot(v.hdfs_usage(), "c1", _STORE_NOW), "storage")


@query("read_storage_series", "X3 P26 P28", f"""
SELECT {_STORAGE} FROM ({merged_sql('usage', f"cluster = 'c1' AND lower(path) = '/click/7' AND run_id BETWEEN {_STORE_NOW + 864000 - 604800} AND {_STORE_NOW + 864000}")})
ORDER BY run_id DESC LIMIT 8""", "usage")
def read_storage_series(v: Views):
    return R.at_detail(R.storage_series(v.hdfs_usage(), "c1", "/click/7", _STORE_NOW + 864000, limit=8), "storage")


_FRESH = app_summary_sql("(" + flows_sql(f"(SELECT * FROM job_history WHERE cluster = '{CLUSTER}' AND run_id > {NEW_NOW - 86400000} AND run_id <= {NEW_NOW})") + ")")


@query("read_new_apps", "X3 J3 P28", f"""
SELECT cluster, user_name, app_id, number_runs, first_run_id, last_run_id, job_count, total_maps, total_reduces,
  map_slot_millis, reduce_slot_millis, mb_millis, queues FROM (
  SELECT cluster, user_name, app_id FROM versions WHERE cluster = '{CLUSTER}' AND version = 'P'
  GROUP BY ALL HAVING min(first_seen) BETWEEN {NEW_NOW - 86400000} AND {NEW_NOW})
JOIN ({_FRESH}) USING (cluster, user_name, app_id)""", "versions job_history")
def read_new_apps(v: Views):
    # applications count as new when they first left a partial job, so some are new on that day
    partial = v.app_version().filter(F.col("version") == "P")
    return R.new_apps(partial, v.job_history(), CLUSTER, NEW_NOW)


@query("read_all_apps", "X3 A9 P28", f"""
SELECT {', '.join(R.ALL_APPS)} FROM ({_merged_days(f"cluster = '{CLUSTER}' AND user_name = '{USER}' AND period_start BETWEEN {NOW - 86400000} AND {NOW}")})""", "daily")
def read_all_apps(v: Views):
    return R.all_apps(apps.period_totals(v.job_history(), "day"), CLUSTER, NOW, USER)
