"""Query registry and the SQL twins of the views in :mod:`runledger.plans.views`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ITEMS: dict[str, str] = {}

_SQL: dict[str, tuple[str, list[str]]] = {}
_NEEDS: dict[str, list[str]] = {}
_VIEW_SQL: dict[str, str] = {}


def query(name: str, items: str, sql: str | None = None, views: str = ""):
    """Registers ``build(views) -> DataFrame``; ``views`` names the SQL views the text reads."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        ITEMS[name] = items
        if sql is not None:
            _SQL[name] = (sql, views.split())
        return build

    return register


def sql_texts() -> dict[str, str]:
    """The SQL of every query that has one, with the views it reads put in front."""
    return {name: with_views(text, views) for name, (text, views) in _SQL.items()}


def view_sql(name: str, text: str, needs: str = "") -> None:
    _VIEW_SQL[name] = text
    _NEEDS[name] = needs.split()


def with_views(sql: str, names: list[str]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _NEEDS[name]:
            visit(n)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({_VIEW_SQL[n]})" for n in order) + "\n" + sql


view_sql("orders_k", """
SELECT r_name AS cluster, c_mktsegment AS user_name, o_orderpriority AS app_id,
  epoch_ms(CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP)) AS run_id,
  CAST(1 AS BIGINT) AS job_epoch, o_orderkey AS job_seq, printf('job_1_%04d', o_orderkey) AS job_id,
  o_orderstatus AS job_status, o_orderstatus AS version, n_name AS queue, 'ONE' AS history_version,
  epoch_ms(o_orderdate) AS submit_time, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'PIG' WHEN 'MACHINERY' THEN 'SCALDING' ELSE 'NONE' END AS framework,
  o_orderdate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey""")

view_sql("measures", """
SELECT l_orderkey,
  CAST(count(*) FILTER (l_returnflag <> 'R') AS BIGINT) AS total_maps,
  CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS total_reduces,
  CAST(count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS BIGINT) AS finished_maps,
  CAST(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS BIGINT) AS finished_reduces,
  CAST(count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS BIGINT) AS failed_maps,
  CAST(count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS BIGINT) AS failed_reduces,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS hdfs_bytes_read,
  CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS hdfs_bytes_written,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS BIGINT) AS reduce_shuffle_bytes,
  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS map_file_bytes_read,
  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_tax * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS map_file_bytes_written,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS reduce_file_bytes_read,
  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS map_slot_millis,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS reduce_slot_millis,
  epoch_ms(min(l_shipdate)) AS launch_time, epoch_ms(max(l_shipdate)) AS finish_time
FROM lineitem GROUP BY l_orderkey""")

MEASURES = [
    "total_maps", "total_reduces", "finished_maps", "finished_reduces", "failed_maps", "failed_reduces",
    "hdfs_bytes_read", "hdfs_bytes_written", "reduce_shuffle_bytes", "map_file_bytes_read",
    "map_file_bytes_written", "reduce_file_bytes_read", "map_slot_millis", "reduce_slot_millis",
    "launch_time", "finish_time",
]

view_sql("job_history", f"""
SELECT *, map_slot_millis * 2 + reduce_slot_millis * 3 AS mb_millis,
  CAST(map_slot_millis + reduce_slot_millis AS DOUBLE) AS cost
FROM (SELECT o.*, {', '.join(f'coalesce(m.{c}, 0) AS {c}' for c in MEASURES)}
  FROM orders_k o LEFT JOIN measures m ON o.job_seq = m.l_orderkey)""", "orders_k measures")

view_sql("tasks", """
SELECT CAST(1 AS BIGINT) AS job_epoch, l_orderkey AS job_seq, printf('job_1_%04d', l_orderkey) AS job_id,
  concat_ws('_', l_linenumber, l_partkey, l_suppkey) AS task_key,
  CASE WHEN l_returnflag = 'R' THEN 'REDUCE' ELSE 'MAP' END AS task_type, l_linestatus AS task_status,
  epoch_ms(l_shipdate) AS task_finish_time, CAST(round(l_extendedprice * 100) AS BIGINT) AS task_millis
FROM lineitem""")

view_sql("cells", """
SELECT l_orderkey, kind, l_returnflag AS counter_group, l_linestatus AS counter_name,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value
FROM lineitem, (VALUES ('total'), ('map'), ('reduce')) k(kind)
WHERE kind = 'total' OR (kind = 'reduce') = (l_returnflag = 'R')
GROUP BY ALL""")

SUMS = [
    "total_maps", "total_reduces", "hdfs_bytes_read", "hdfs_bytes_written", "reduce_shuffle_bytes",
    "map_file_bytes_read", "map_file_bytes_written", "reduce_file_bytes_read", "map_slot_millis",
    "reduce_slot_millis", "mb_millis",
]


def sums(columns: list[str]) -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in columns)


def flows_sql(source: str) -> str:
    """Flow roll-up over a relation of job rows."""
    return f"""
SELECT *, finish_time - launch_time AS duration, finish_time - submit_time AS wall_clock_time
FROM (SELECT cluster, user_name, app_id, run_id, count(*) AS job_count, {sums(SUMS)}, sum(cost) AS cost,
  CAST(coalesce(min(nullif(submit_time, 0)), 0) AS BIGINT) AS submit_time,
  coalesce(min(nullif(launch_time, 0)), 0) AS launch_time, max(finish_time) AS finish_time,
  min(history_version) AS history_version,
  arg_min(queue, submit_time * 100000000 + job_seq) AS queue, arg_max(version, job_seq) AS version
FROM (SELECT * REPLACE (CAST(submit_time AS HUGEINT) AS submit_time) FROM {source})
GROUP BY cluster, user_name, app_id, run_id)"""


view_sql("flows", flows_sql("job_history"), "job_history")


def queue_list(expr: str = "queue") -> str:
    return f"coalesce(array_to_string(list_sort(list(DISTINCT {expr})), '!') || '!', '')"


def app_summary_sql(source: str) -> str:
    cols = ["job_count", "total_maps", "total_reduces", "mb_millis", "map_slot_millis", "reduce_slot_millis"]
    return f"""
SELECT cluster, user_name, app_id, count(*) AS number_runs, {sums(cols)}, {queue_list()} AS queues,
  coalesce(min(nullif(run_id, 0)), 0) AS first_run_id, max(run_id) AS last_run_id
FROM {source} GROUP BY cluster, user_name, app_id"""


TOTALS = ["total_maps", "total_reduces", "mb_millis", "map_slot_millis", "reduce_slot_millis"]


def period_sql(start: str) -> str:
    return f"""
SELECT cluster, {start} AS period_start, user_name, app_id, {sums(TOTALS)}, count(*) AS job_count,
  count(DISTINCT run_id) AS number_runs, sum(cost) AS cost, {queue_list()} AS queues
FROM job_history GROUP BY ALL"""


DAY = "(run_id - ((run_id % 86400000 + 86400000) % 86400000))"
WEEK = f"(({DAY} // 86400000 - ((({DAY} // 86400000) + 4) % 7 + 7) % 7) * 86400000)"
view_sql("daily", period_sql(DAY), "job_history")
view_sql("versions", """
SELECT cluster, user_name, app_id, version, min(run_id) AS first_seen FROM orders_k GROUP BY ALL""", "orders_k")

view_sql("flow_event", """
SELECT 'c' || (user_id % 3) AS cluster, user_id AS flow_id, event_id AS sequence, epoch_us(ts) // 1000 AS ts,
  event_type AS type, props AS data FROM events""")
view_sql("updates", """
SELECT 'c' || (user_id % 3) AS cluster, user_id AS flow_id, user_id * 1000 AS ts,
  CASE WHEN user_id % 7 <> 0 THEN 'u' || (user_id % 10) END AS user_name,
  CASE WHEN event_type IN ('click', 'view') THEN 'RUNNING' WHEN event_type IN ('purchase', 'signup')
    THEN 'SUCCEEDED' ELSE 'FAILED' END AS status, event_id AS update_seq FROM events""")
view_sql("status", """
SELECT * FROM updates QUALIFY row_number() OVER (PARTITION BY cluster, flow_id ORDER BY update_seq DESC) = 1""",
         "updates")
view_sql("usage_writes", """
SELECT 'c' || (user_id % 3) AS cluster, '/' || event_type || '/' || (user_id % 20) AS path, 'ns' || (k % 3) AS namespace,
  CAST(epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 3600 AS BIGINT) AS run_id,
  k AS file_count, k % 5 AS dir_count, CAST(round(value * 100) AS BIGINT) AS space_consumed,
  event_id % 100 AS access_count, k * 10 AS quota, k * 100 AS space_quota,
  CAST(0 AS BIGINT) AS tmp_file_count, CAST(0 AS BIGINT) AS tmp_space_consumed, k % 2 AS trash_file_count,
  k % 4 AS trash_space_consumed, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS access_cost,
  CAST(k AS DOUBLE) AS storage_cost, 'o' || (user_id % 10) AS owner, event_id AS write_ts
FROM (SELECT *, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events)""")
view_sql("usage", """
SELECT * FROM usage_writes QUALIFY row_number() OVER
  (PARTITION BY run_id, cluster, path, namespace ORDER BY write_ts DESC) = 1""", "usage_writes")
COUNTS = [
    "file_count", "dir_count", "space_consumed", "access_count", "quota", "space_quota",
    "tmp_file_count", "tmp_space_consumed", "trash_file_count", "trash_space_consumed",
]


def merged_sql(source: str, where: str = "true") -> str:
    return f"""
SELECT cluster, path, run_id, {sums(COUNTS)}, sum(access_cost) AS access_cost, sum(storage_cost) AS storage_cost,
  arg_max(owner, namespace) AS owner, sum(access_cost) + sum(storage_cost) AS hdfs_cost
FROM {source} WHERE {where} GROUP BY cluster, path, run_id"""


view_sql("merged_usage", merged_sql("usage"), "usage")
view_sql("files", """
SELECT source AS cluster, source || '/job_1_' || (doc_id // 2) || CASE WHEN doc_id % 2 = 0 THEN '_conf.xml' ELSE '_hist' END AS path,
  doc_id AS mod_time, n_chars AS length FROM documents""")
view_sql("job_files", """
SELECT *, string_split(path, '/')[2] AS file_name, regexp_extract(path, '(job_[0-9]+_[0-9]+)', 1) AS job_id,
  CASE WHEN path LIKE '%conf.xml' THEN 'conf' ELSE 'history' END AS kind FROM files""", "files")
view_sql("raw_jobs", """
SELECT 'c1' AS cluster, printf('job_1_%04d', doc_id // 2) AS job_id, CAST(1 AS BIGINT) AS job_epoch, doc_id // 2 AS job_seq,
  max(CASE WHEN doc_id % 2 = 0 THEN text END) AS conf, max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS conf_mod_time,
  max(CASE WHEN doc_id % 2 = 1 THEN text END) AS history, max(CASE WHEN doc_id % 2 = 1 THEN doc_id END) AS history_mod_time,
  CASE max(n_chars) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS processed_ok,
  CASE max(n_chars) % 5 WHEN 0 THEN true WHEN 1 THEN false END AS reprocess
FROM documents GROUP BY doc_id // 2""")
