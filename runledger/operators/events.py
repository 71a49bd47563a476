"""Run events and live run status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import defaults as D
from .ordering import page

EVENT_KEY = ["cluster", "flow_id", "sequence"]
STATUS_KEY = ["cluster", "flow_id"]


def last_write_wins(events: DataFrame, write_order: str = "write_seq") -> DataFrame:
    """One row per event key, the one written last."""
    rest = [c for c in events.columns if c not in EVENT_KEY]
    picked = events.groupBy(*EVENT_KEY).agg(F.max_by(F.struct(*rest), write_order).alias("row"))
    return picked.select(*EVENT_KEY, "row.*")


def flow_events(events: DataFrame, cluster: str, flow_id, since: int | None = None) -> DataFrame:
    """Events of a flow in sequence order, optionally only those behind a sequence."""
    rows = events.filter((F.col("cluster") == cluster) & (F.col("flow_id") == flow_id))
    if since is not None:
        rows = rows.filter(F.col("sequence") > since)
    return rows.orderBy("sequence")


def latest_status(updates: DataFrame) -> DataFrame:
    """Current row of every flow from its status updates; the last update wins."""
    rest = [c for c in updates.columns if c not in STATUS_KEY]
    picked = updates.groupBy(*STATUS_KEY).agg(F.max_by(F.struct(*rest), "update_seq").alias("row"))
    return picked.select(*STATUS_KEY, "row.*")


def move_status(statuses: DataFrame, moves: DataFrame) -> DataFrame:
    """Rows with their status changed; a move whose old row does not exist is an error row.

    ``moves`` holds cluster, flow_id, ts, old_status, new_status.
    """
    key = [*STATUS_KEY, "ts"]
    renamed = moves.select(*key, F.col("old_status").alias("status"), "new_status").withColumn("_move", F.lit(True))
    kept = statuses.withColumn("_row", F.lit(True)).join(renamed, [*key, "status"], "full_outer")
    return kept.withColumn(
        "error", F.when(F.col("_row").isNull(), F.concat(F.lit("no row for flow "), F.col("flow_id").cast("string")))
    ).withColumn("status", F.coalesce("new_status", "status")).drop("_row", "_move", "new_status")


def with_status(statuses: DataFrame, cluster: str | None, status: str, user: str | None = None) -> DataFrame:
    """Flows of a status, newest first; with a user given, flows without one drop out."""
    return _of_status(statuses, cluster, status, user).orderBy(F.col("ts").desc(), "cluster", "flow_id")


def _of_status(statuses: DataFrame, cluster: str | None, status: str, user: str | None) -> DataFrame:
    rows = statuses.filter(F.col("status") == status)
    if cluster is not None:
        rows = rows.filter(F.col("cluster") == cluster)
    if user is not None:
        rows = rows.filter(F.col("user_name") == user)
    return rows


def by_id(statuses: DataFrame, cluster: str, ts: int, flow_id) -> DataFrame:
    """A flow whatever its status; with several rows the first status in look-up order."""
    rows = statuses.filter(
        (F.col("cluster") == cluster) & (F.col("ts") == ts) & (F.col("flow_id") == flow_id)
        & F.col("status").isin(*D.RUN_STATE_ORDER)
    )
    return rows.orderBy(D.run_state_rank(F.col("status"))).limit(1)


def first_of_statuses(statuses: DataFrame) -> DataFrame:
    """The look-up of :func:`by_id` for every flow at once."""
    key = [*STATUS_KEY, "ts"]
    rest = [c for c in statuses.columns if c not in key]
    known = statuses.filter(F.col("status").isin(*D.RUN_STATE_ORDER))
    picked = known.groupBy(*key).agg(F.min_by(F.struct(*rest), D.run_state_rank(F.col("status"))).alias("row"))
    return picked.select(*key, "row.*")


def status_page(
    statuses: DataFrame, cluster: str, status: str, limit: int, user: str | None = None,
    start: tuple[int, object] | None = None,
) -> DataFrame:
    """A page of flows of a status; ``start`` is the (ts, flow_id) key the page begins with."""
    at = None
    if start is not None:
        ts, flow_id = start
        at = (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("flow_id") >= flow_id))
    return page(_of_status(statuses, cluster, status, user), [F.col("ts").desc(), F.col("flow_id")], limit, at)
