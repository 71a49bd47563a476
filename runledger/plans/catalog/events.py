"""Run event and run status queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import events as O
from ..views import Views
from .registry import query


@query("flow_events", "P22", "SELECT * FROM flow_event WHERE cluster = 'c1' AND flow_id = 7", "flow_event")
def flow_events(v: Views):
    return O.flow_events(v.flow_event(), "c1", 7)


@query("flow_events_since", "P23", "SELECT * FROM flow_event WHERE cluster = 'c1' AND flow_id = 7 AND sequence > 400", "flow_event")
def flow_events_since(v: Views):
    return O.flow_events(v.flow_event(), "c1", 7, since=400)


@query("event_last_write", "S17", """
SELECT cluster, flow_id, sequence, ts, type, data, write_seq FROM (
  SELECT *, sequence AS write_seq FROM (SELECT * FROM flow_event WHERE type <> 'view')
  UNION ALL
  SELECT * REPLACE ('view' AS type), sequence + 1000000 AS write_seq FROM flow_event WHERE type IN ('error', 'view'))
QUALIFY row_number() OVER (PARTITION BY cluster, flow_id, sequence ORDER BY write_seq DESC) = 1""", "flow_event")
def event_last_write(v: Views):
    events = v.flow_event()
    first = events.filter(F.col("type") != "view").withColumn("write_seq", F.col("sequence"))
    again = events.filter(F.col("type").isin("error", "view")).withColumn("type", F.lit("view")).withColumn(
        "write_seq", F.col("sequence") + 1000000
    )
    return O.last_write_wins(first.unionByName(again))


@query("flow_status", "T5", "SELECT * FROM status", "status")
def flow_status(v: Views):
    return v.flow_status()


@query("flows_of_status", "P20", "SELECT * FROM status WHERE status = 'RUNNING'", "status")
def flows_of_status(v: Views):
    return O.with_status(v.flow_status(), None, "RUNNING")


@query("flows_of_status_and_user", "P20", "SELECT * FROM status WHERE status = 'RUNNING' AND user_name = 'u3'", "status")
def flows_of_status_and_user(v: Views):
    return O.with_status(v.flow_status(), None, "RUNNING", "u3")


@query("flow_by_id", "P21", "SELECT * FROM status WHERE cluster = 'c2' AND ts = 8000 AND flow_id = 8", "status")
def flow_by_id(v: Views):
    return O.by_id(v.flow_status(), "c2", 8000, 8)


@query("flow_first_status", "P21 U2", """
SELECT * FROM (SELECT cluster, flow_id, ts, user_name, status, min(update_seq) AS update_seq FROM updates GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY cluster, flow_id, ts
  ORDER BY CASE status WHEN 'RUNNING' THEN 1 WHEN 'SUCCEEDED' THEN 2 ELSE 3 END) = 1""", "updates")
def flow_first_status(v: Views):
    # one row per flow and status, as when a move left its old row behind
    rows = v.status_updates().groupBy("cluster", "flow_id", "ts", "user_name", "status").agg(
        F.min("update_seq").alias("update_seq")
    )
    return O.first_of_statuses(rows)


def _page(limit: int, more: str) -> str:
    return f"""SELECT *, page_row > {limit} AS is_next FROM (
SELECT *, CAST(row_number() OVER (ORDER BY ts DESC, flow_id) AS BIGINT) AS page_row FROM status
WHERE cluster = 'c1' AND status = 'RUNNING'{more}) WHERE page_row <= {limit + 1}"""


@query("status_page", "W5", _page(3, ""), "status")
def status_page(v: Views):
    return O.status_page(v.flow_status(), "c1", "RUNNING", 3)


@query("status_next_page", "W5", _page(2, " AND (ts < 7000 OR (ts = 7000 AND flow_id >= 7))"), "status")
def status_next_page(v: Views):
    return O.status_page(v.flow_status(), "c1", "RUNNING", 2, start=(7000, 7))


@query("status_moved", "T5", """
SELECT cluster, flow_id, ts, user_name, CASE WHEN status = 'RUNNING' THEN 'SUCCEEDED' ELSE status END AS status, update_seq,
  CAST(NULL AS VARCHAR) AS error FROM status
UNION ALL
SELECT cluster, flow_id, ts, NULL, 'SUCCEEDED', NULL, 'no row for flow ' || flow_id FROM status WHERE status = 'FAILED'
""", "status")
def status_moved(v: Views):
    statuses = v.flow_status()
    # running flows succeed; the flows that failed have no running row to move
    moves = statuses.filter(F.col("status").isin("RUNNING", "FAILED")).select(
        "cluster", "flow_id", "ts", F.lit("RUNNING").alias("old_status"), F.lit("SUCCEEDED").alias("new_status")
    )
    return O.move_status(statuses, moves)
