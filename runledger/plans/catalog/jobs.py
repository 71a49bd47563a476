"""Job and task queries: projections, conf filters, counters, exports, repair, cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import conf as C, counters as K
from ...operators import apps, flows, jobs as O, storage
from ...session import new_work_path
from ...sources import export as X
from ...sources.properties import read_clusters, read_rates
from .. import reads
from ..views import Views
from .registry import app_summary_sql, query, view_sql

_CONF_KEYS = ["mapreduce.job.user.name", "user.name", "mapreduce.job.name", "mapreduce.job.queuename", "pig.version",
              "pig.logical.plan.signature", "pig.script.submitted.timestamp", "pig.logfile", "cascading.flow.id",
              "scalding.flow.class.signature", "mapred.app.submitted.timestamp", "mapreduce.map.memory.mb",
              "mapreduce.reduce.memory.mb", "yarn.app.mapreduce.am.resource.mb", "mapred.child.java.opts"]

view_sql("confs", """
SELECT *, CASE WHEN version <> 'P' THEN user_name END AS "mapreduce.job.user.name",
  'old ' || user_name AS "user.name", app_id || '[' || job_seq || ']' AS "mapreduce.job.name",
  CASE WHEN version = 'O' THEN 'default' ELSE queue END AS "mapreduce.job.queuename",
  CASE WHEN framework = 'PIG' THEN '0.11' END AS "pig.version",
  CASE WHEN framework = 'PIG' THEN ' sig_' || version || ' ' END AS "pig.logical.plan.signature",
  CASE WHEN framework = 'PIG' AND version = 'F' THEN CAST(run_id AS VARCHAR) END AS "pig.script.submitted.timestamp",
  CASE WHEN framework = 'PIG' AND version = 'O' THEN '/tmp/pig_' || submit_time || '.log' END AS "pig.logfile",
  CASE WHEN framework = 'SCALDING' THEN md5(CAST(job_seq AS VARCHAR)) END AS "cascading.flow.id",
  CASE WHEN framework = 'SCALDING' THEN 'v' || version END AS "scalding.flow.class.signature",
  CASE WHEN framework = 'NONE' AND version = 'F' THEN CAST(run_id AS VARCHAR) END AS "mapred.app.submitted.timestamp",
  CASE WHEN version = 'F' THEN '2048' END AS "mapreduce.map.memory.mb", '4096' AS "mapreduce.reduce.memory.mb",
  '1536' AS "yarn.app.mapreduce.am.resource.mb", '-Xmx' || (job_seq % 7 + 1) || 'g -verbose:gc' AS "mapred.child.java.opts"
FROM orders_k""", "orders_k")

view_sql("conf_rows", "\nUNION ALL ".join(
    f"SELECT job_id, '{k}' AS key, \"{k}\" AS value FROM confs WHERE \"{k}\" IS NOT NULL" for k in _CONF_KEYS), "confs")


def _conf_rows(v: Views, keep=None):
    conf = F.col("conf") if keep is None else C.filter_keys(F.col("conf"), keep)
    return v.flow_jobs_conf().select("job_id", F.explode(conf).alias("key", "value"))


@query("conf_rows", "P10", "SELECT * FROM conf_rows", "conf_rows")
def conf_rows(v: Views):
    from ..views import conf_values

    return v._orders().select("job_id", F.explode(C.wide_to_map(conf_values())).alias("key", "value"))


@query("conf_listed_keys", "P8", "SELECT * FROM conf_rows WHERE key IN ('user.name', 'pig.version', 'no.such.key')", "conf_rows")
def conf_listed_keys(v: Views):
    return _conf_rows(v, C.keys_in(["user.name", "pig.version", "no.such.key"]))


@query("conf_matching_keys", "P9", r"SELECT * FROM conf_rows WHERE regexp_full_match(key, 'mapreduce\..*\.mb') OR regexp_full_match(key, '.*pig')", "conf_rows")
def conf_matching_keys(v: Views):
    return _conf_rows(v, C.keys_matching([r"mapreduce\..*\.mb", ".*pig"]))


@query("conf_keys_by_rule", "X2", "SELECT * FROM conf_rows WHERE length(key) < 12", "conf_rows")
def conf_keys_by_rule(v: Views):
    return _conf_rows(v, lambda k: F.length(k) < 12)


@query("counter_values", "P12", """
SELECT job_id, coalesce(max(value) FILTER (kind = 'total' AND counter_group = 'A' AND counter_name = 'F'), 0) AS a_f,
  coalesce(max(value) FILTER (kind = 'reduce' AND counter_group = 'R' AND counter_name = 'O'), 0) AS r_o,
  CAST(0 AS BIGINT) AS none FROM orders_k LEFT JOIN cells ON job_seq = l_orderkey GROUP BY job_id""", "orders_k cells")
def counter_values(v: Views):
    return v.jobs_with_counters().select(
        "job_id", K.value(F.col("counters"), "A", "F").alias("a_f"),
        K.value(F.col("reduce_counters"), "R", "O").alias("r_o"), K.value(F.col("map_counters"), "R", "O").alias("none"),
    )


@query("counter_qualifiers", "P11", """
SELECT l_orderkey, counter_group, counter_name, value FROM cells WHERE kind = 'total'""", "cells")
def counter_qualifiers(v: Views):
    cells = v.counters().select("l_orderkey", F.concat_ws("!", "l_returnflag", "l_linestatus").alias("q"), "value")
    return cells.select("l_orderkey", K.from_qualifier(F.col("q"), F.col("value")).alias("c")).select("l_orderkey", "c.*")


_STATS = list(O.STAT_COUNTERS)


@query("job_details", "P13 F30 F26", f"""
SELECT job_id, {', '.join(_STATS)}, total_maps, failed_reduces, finish_time - launch_time AS run_time,
  CASE WHEN version = 'P' THEN 0 ELSE submit_time END AS submit_time, CASE WHEN version = 'P' THEN '' ELSE queue END AS queue,
  CASE WHEN version = 'P' THEN 0.0 ELSE cost END AS cost FROM job_history""", "job_history")
def job_details(v: Views):
    jobs = v.job_history()
    odd = F.col("job_seq") % 2 == 1
    unset = F.col("version") == "P"
    jobs = jobs.withColumn("history_version", F.when(odd, F.lit("TWO")).otherwise(F.lit("ONE")))
    stored = {}
    for target in ("counters", "map_counters", "reduce_counters"):
        names = {n: (g, c) for n, (t, g, c) in O.STAT_COUNTERS.items() if t == target}

        def cells(groups):
            return K.nested(F.array(*[
                F.struct(F.lit(groups[g]).alias("counter_group"), F.lit(c).alias("counter_name"), F.col(n).alias("value"))
                for n, (g, c) in names.items()
            ]))

        stored[target] = F.when(odd, cells(O.GROUPS_TWO)).otherwise(cells(O.GROUPS_ONE))
    jobs = jobs.withColumns(stored).drop(*_STATS)
    for c in ("submit_time", "queue", "cost"):
        jobs = jobs.withColumn(c, F.when(~unset, F.col(c)))
    return O.job_details(jobs).select(
        "job_id", *_STATS, "total_maps", "failed_reduces", "run_time", "submit_time", "queue", "cost"
    )


@query("task_details", "P14", """
SELECT job_id, task_key, task_type, CASE WHEN task_status = 'O' THEN 0 ELSE task_finish_time END AS finish_time,
  CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 2 END AS split_count, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'h' || l_suppkey END AS second_host
FROM (SELECT t.*, CAST(string_split(task_key, '_')[1] AS INTEGER) AS l_linenumber, string_split(task_key, '_')[3] AS l_suppkey FROM tasks t)""", "tasks")
def task_details(v: Views):
    parts = F.split("task_key", "_")
    tasks = v.tasks_only().select(
        "job_id", "task_key", "task_type",
        F.when(F.col("task_status") != "O", F.col("task_finish_time")).alias("finish_time"),
        F.when(parts[0].cast("int") % 3 != 0, F.concat(F.lit("h"), parts[1], F.lit(",h"), parts[2])).alias("splits"),
    )
    shaped = O.task_details(tasks)
    return shaped.select(
        "job_id", "task_key", "task_type", "finish_time", F.size("splits").alias("split_count"),
        F.try_element_at("splits", F.lit(2)).alias("second_host"),
    )


@query("jobs_of_framework", "P17", """
SELECT job_id, framework, submit_time FROM job_history WHERE framework = 'PIG' AND version <> 'P'
AND submit_time >= 820454400000 AND submit_time < 899251200000""", "job_history")
def jobs_of_framework(v: Views):
    jobs = v.job_history().withColumn("submit_time", F.when(F.col("version") != "P", F.col("submit_time")))
    return O.jobs_of_framework(jobs, "PIG", ["job_id", "framework", "submit_time"], 820454400000, 899251200000)


@query("jobs_of_framework_limited", "P17", """
SELECT job_id, framework FROM job_history WHERE framework = 'SCALDING'
ORDER BY cluster, user_name, app_id, run_id, job_epoch, job_seq LIMIT 12""", "job_history")
def jobs_of_framework_limited(v: Views):
    return O.jobs_of_framework(v.job_history(), "SCALDING", ["job_id", "framework"], limit=12)


@query("partial_jobs", "P18", "SELECT job_seq, version FROM orders_k WHERE version IN ('P', 'O')", "orders_k")
def partial_jobs(v: Views):
    broken = F.when(F.col("version") == "O", F.lit("")).when(F.col("version") != "P", F.col("job_id"))
    return O.partial_jobs(v._orders().withColumn("job_id", broken)).select("job_seq", "version")


def _removal(v: Views):
    jobs = v._orders()
    tasks = v.tasks_only().withColumn("cluster", F.lit("c"))
    jobs = jobs.withColumn("cluster", F.lit("c"))
    return O.removal(jobs, tasks, jobs.filter(F.col("version") == "P"))


@query("rows_removed", "S13", """
SELECT 'c' AS cluster, job_id, 1 + (SELECT count(*) FROM lineitem WHERE l_orderkey = job_seq) AS rows_removed
FROM orders_k WHERE version = 'P'""", "orders_k")
def rows_removed(v: Views):
    return _removal(v)[2]


@query("tasks_kept", "S13", """
SELECT job_id, task_key, task_millis FROM tasks WHERE job_seq NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""", "tasks")
def tasks_kept(v: Views):
    return _removal(v)[1].select("job_id", "task_key", "task_millis")


@query("cluster_of_host", "J5", """
SELECT job_id, CASE WHEN version = 'P' THEN NULL ELSE cluster END AS found FROM orders_k""", "orders_k")
def cluster_of_host(v: Views):
    places = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    clusters = places.select(F.col("n_name").alias("host"), F.col("r_name").alias("cluster"))
    port = F.concat(F.col("queue"), F.lit(":8032"))
    address = F.when(F.col("version") == "O", port)
    tracker = F.when(F.col("version") == "P", F.lit("elsewhere:8021")).otherwise(F.col("queue"))
    pairs = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit(C.RESOURCE_MANAGER_KEY).alias("key"), address.alias("value")),
        F.struct(F.lit(C.JOB_TRACKER_KEY).alias("key"), tracker.alias("value")),
    ), lambda p: p["value"].isNotNull()))
    hosts = v._orders().select("job_id", C.tracker_host(pairs).alias("host"))
    return O.cluster_of_host(hosts, clusters).select("job_id", F.col("cluster").alias("found"))


@query("job_costs", "J6 F23", """
SELECT job_id, CASE WHEN version = 'P' OR r_regionkey = 0 THEN 0.0
  ELSE CAST(mb_millis AS DOUBLE) * (r_regionkey * 1.5) / CAST(86400000 * (1024 * (r_regionkey + 1)) AS DOUBLE) END AS cost
FROM (SELECT j.*, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM job_history j JOIN region ON cluster = r_name)""", "job_history")
def job_costs(v: Views):
    key = F.col("r_regionkey").cast("bigint")
    rates = v.table("region").select(
        F.col("r_name").alias("machine_type"), (key * F.lit(1.5)).alias("compute_cost"),
        ((key + 1) * 1024).alias("machine_memory"),
    )
    jobs = v.job_history().withColumn(
        "machine_type", F.when(F.col("version") == "P", F.lit("unknown")).otherwise(F.col("cluster"))
    )
    return O.with_cost(jobs, rates).select("job_id", "cost")


# --- exports ------------------------------------------------------------------------------------

_FLOW_JSON = ["cluster", "user_name", "app_id", "run_id", "job_count", "total_maps", "total_reduces", "queue", "version"]


@query("flow_json", "S14", f"SELECT to_json({{{', '.join(f'{c}: {c}' for c in _FLOW_JSON)}}})::VARCHAR AS json FROM flows", "flows")
def flow_json(v: Views):
    return X.to_json_lines(flows.roll_up(v.job_history()), _FLOW_JSON)


@query("json_round_trip", "S19", """
SELECT job_id, counter_group, counter_name, value FROM orders_k JOIN cells ON job_seq = l_orderkey WHERE kind = 'total'""", "orders_k cells")
def json_round_trip(v: Views):
    columns = ["cluster", "user_name", "app_id", "run_id", "job_id", "job_status", "counters", "map_counters", "reduce_counters"]
    back = X.parse_json_lines(X.to_json_lines(v.jobs_with_counters(), columns), X.EXPORTED_JOB)
    cells = flows.explode_counters(back, ["job_id"])
    return cells.filter(F.col("kind") == "total").drop("kind")


@query("json_written_and_read", "S14 S19", "SELECT job_id, kind, counter_group, counter_name, value FROM orders_k JOIN cells ON job_seq = l_orderkey", "orders_k cells")
def json_written_and_read(v: Views):
    """Jobs exported to JSON files and read back: the counters of all kinds."""
    path = new_work_path(v.spark, "jobs-json")
    X.write_json(v.jobs_with_counters().select("cluster", "user_name", "app_id", "run_id", "job_id", "job_status", "counters", "map_counters", "reduce_counters"), path)
    return flows.explode_counters(X.read_json(v.spark, path, X.EXPORTED_JOB), ["job_id"])


@query("apps_written_and_read", "S14 P15", f"SELECT {', '.join(reads.NEW_APPS)} FROM ({app_summary_sql('flows')})", "flows")
def apps_written_and_read(v: Views):
    path = new_work_path(v.spark, "apps-json")
    rows = reads.at_detail(apps.summarize(flows.roll_up(v.job_history())), "new_apps")
    X.write_json(rows, path)
    return X.read_json(v.spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("storage_written_and_read", "S14 P16", f"SELECT {', '.join(reads.STORAGE)} FROM merged_usage", "merged_usage")
def storage_written_and_read(v: Views):
    path = new_work_path(v.spark, "storage-json")
    rows = reads.at_detail(storage.merge_namespaces(v.hdfs_usage()), "storage")
    X.write_json(rows, path)
    return X.read_json(v.spark, path, rows.schema.simpleString()[7:-1].replace(":", " "))


@query("cluster_of_host_from_file", "J5", """
SELECT job_id, CASE WHEN version <> 'P' THEN cluster END AS found FROM orders_k""", "orders_k")
def cluster_of_host_from_file(v: Views):
    """Clusters from a property file of hosts."""
    path = new_work_path(v.spark, "hosts")
    places = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    escaped = F.regexp_replace("n_name", "([ :=])", r"\\$1")
    lines = places.select(F.explode(F.array(F.lit("# host"), F.lit(""), F.concat(F.lit("  "), escaped, F.lit(" = "), "r_name"))).alias("value"))
    lines.write.text(path)
    hosts = v._orders().select("job_id", F.when(F.col("version") == "P", F.lit("elsewhere")).otherwise(F.col("queue")).alias("host"))
    return O.cluster_of_host(hosts, read_clusters(v.spark, path)).select("job_id", F.col("cluster").alias("found"))


@query("job_costs_from_file", "J6 F23", """
SELECT job_id, CASE WHEN version = 'P' OR r_regionkey = 0 THEN 0.0
  ELSE CAST(mb_millis AS DOUBLE) * (r_regionkey * 1.5) / CAST(86400000 * (1024 * (r_regionkey + 1)) AS DOUBLE) END AS cost
FROM (SELECT j.*, CAST(r_regionkey AS BIGINT) AS r_regionkey FROM job_history j JOIN region ON cluster = r_name)""", "job_history")
def job_costs_from_file(v: Views):
    """Rates from a property file; machine type 0 has a malformed rate."""
    path = new_work_path(v.spark, "rates")
    key = F.col("r_regionkey").cast("bigint")
    rate = F.when(key == 0, F.lit("free")).otherwise((key * F.lit(1.5)).cast("string"))
    kind = F.concat(F.lit("rack."), key.cast("string"))
    pair = F.array(F.concat(kind, F.lit(".computecost="), rate), F.concat(kind, F.lit(".machinememory: "), ((key + 1) * 1024).cast("string")))
    v.table("region").select(F.explode(pair).alias("value")).write.text(path)
    types = v.table("region").select(F.col("r_name").alias("cluster"), kind.alias("type"))
    jobs = v.job_history().join(types, "cluster").withColumn("machine_type", F.when(F.col("version") == "P", F.lit("unknown")).otherwise(F.col("type")))
    return O.with_cost(jobs, read_rates(v.spark, path)).select("job_id", "cost")


@query("tab_lines_written", "S15", """
SELECT concat_ws(chr(9), job_id, coalesce(nullif(version, 'P'), '-'), CAST(total_maps AS VARCHAR),
  coalesce(CAST(CASE WHEN version <> 'P' THEN hdfs_bytes_read END AS VARCHAR), 'none')) AS value FROM job_history""", "job_history")
def tab_lines_written(v: Views):
    path = new_work_path(v.spark, "tab-lines")
    X.write_text(tab_lines(v), path)
    return v.spark.read.text(path)


@query("tab_lines", "S15", """
SELECT concat_ws(chr(9), job_id, coalesce(nullif(version, 'P'), '-'), CAST(total_maps AS VARCHAR),
  coalesce(CAST(CASE WHEN version <> 'P' THEN hdfs_bytes_read END AS VARCHAR), 'none')) AS line FROM job_history""", "job_history")
def tab_lines(v: Views):
    known = F.col("version") != "P"
    line = X.tab_separated(
        {
            "jobid": F.col("job_id"), "version": F.when(known, F.col("version")), "total_maps": F.col("total_maps"),
            "g!FileSystemCounters!HDFS_BYTES_READ": F.when(known, F.col("hdfs_bytes_read")),
        },
        null_string="-", null_number="none",
    )
    return v.job_history().select(line.alias("line"))


@query("flow_detail_summary", "P15", f"SELECT {', '.join(reads.FLOW_SUMMARY)} FROM flows", "flows")
def flow_detail_summary(v: Views):
    return reads.at_detail(flows.roll_up(v.job_history()), "flow_summary")


@query("flow_detail_with_jobs", "P15", """
SELECT f.cluster, f.user_name, f.app_id, f.run_id, f.job_count, j.job_id, j.job_status, j.total_maps AS job_total_maps,
  j.mb_millis AS job_mb_millis FROM flows f JOIN job_history j USING (cluster, user_name, app_id, run_id)""", "flows job_history")
def flow_detail_with_jobs(v: Views):
    jobs = v.job_history()
    return reads.flows_with_jobs(flows.roll_up(jobs), jobs).select(
        "cluster", "user_name", "app_id", "run_id", "job_count", "job_id", "job_status", "job_total_maps", "job_mb_millis"
    )


@query("storage_detail", "P16", f"SELECT {', '.join(reads.STORAGE)} FROM merged_usage", "merged_usage")
def storage_detail(v: Views):
    from ...operators import storage

    return reads.at_detail(storage.merge_namespaces(v.hdfs_usage()), "storage")
