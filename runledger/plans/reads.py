"""The read functions: one per question a user of the job-history tables asks.

Every function takes the tables it reads and returns a lazy DataFrame. ``now`` (millis, or
seconds for storage) is an argument, so default windows are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import conf as C, times as T
from ..operators import apps, flows as O, jobs as J, storage as S

DAYS_30 = 30 * T.DAY_MILLIS
WEEK_SECONDS = 7 * 86_400
HOUR_MILLIS = 3_600_000
# default windows of new applications are cut to this many millis, not to the hour
NEW_APPS_STEP_MILLIS = 3_600

FLOW_SUMMARY = [
    "cluster", "user_name", "app_id", "run_id", "version", "history_version", "queue", "job_count", "total_maps",
    "total_reduces", "map_file_bytes_read", "map_file_bytes_written", "reduce_file_bytes_read", "hdfs_bytes_read",
    "hdfs_bytes_written", "map_slot_millis", "reduce_slot_millis", "mb_millis", "cost", "reduce_shuffle_bytes",
    "duration", "wall_clock_time",
]
NEW_APPS = [
    "cluster", "user_name", "app_id", "number_runs", "first_run_id", "last_run_id", "job_count", "total_maps",
    "total_reduces", "map_slot_millis", "reduce_slot_millis", "mb_millis", "queues",
]
ALL_APPS = [
    "cluster", "user_name", "app_id", "number_runs", "first_day", "last_day", "job_count", "total_maps",
    "total_reduces", "cost", "mb_millis", "queues",
]
STORAGE = [
    "cluster", "path", "run_id", "file_count", "dir_count", "space_consumed", "owner", "quota", "space_quota",
    "trash_file_count", "trash_space_consumed", "tmp_file_count", "tmp_space_consumed", "access_count",
    "access_cost", "storage_cost", "hdfs_cost",
]
DETAIL = {"flow_summary": FLOW_SUMMARY, "new_apps": NEW_APPS, "all_apps": ALL_APPS, "storage": STORAGE}


def at_detail(rows: DataFrame, level: str) -> DataFrame:
    """Columns of a detail level; ``everything`` keeps them all."""
    return rows if level == "everything" else rows.select(*DETAIL[level])


def flows_with_jobs(flow_rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Flow summaries with their jobs, one row per job.

    Jobs stay rows of their own: a flow may hold more jobs than fit in one array.
    """
    own = [c for c in jobs.columns if c not in O.FLOW_KEY]
    key = [*O.FLOW_KEY, *O.SOLO]
    shown = O.with_solo(jobs).select(*key, *[F.col(c).alias(c if c.startswith("job_") else f"job_{c}") for c in own])
    keep = [c for c in FLOW_SUMMARY if c in flow_rows.columns]
    return flow_rows.select(*keep, *O.SOLO).join(shown.drop("job_epoch", "job_seq"), key)


def job(jobs: DataFrame, cluster: str, job_id: str) -> DataFrame:
    return J.job_by_id(jobs, cluster, job_id)


def tasks(task_table: DataFrame, cluster: str, job_id: str) -> DataFrame:
    return J.tasks_of_job(task_table, cluster, job_id).orderBy("task_key")


def job_flow(jobs: DataFrame, cluster: str, job_id: str) -> DataFrame:
    return O.flow_of_job(jobs, cluster, job_id)


def flow_series(
    jobs: DataFrame,
    cluster: str,
    user: str,
    app: str,
    limit: int = 1,
    version: str | None = None,
    start: int | None = None,
    end: int = 0,
    now: int | None = None,
    conf_keys: list[str] | None = None,
    conf_patterns: list[str] | None = None,
) -> DataFrame:
    """Newest flows of an application with their jobs; conf cut to the keys asked for.

    With ``now`` given the default window is the 30 days before it, else all runs.
    """
    if now is not None:
        start, end = start or now - DAYS_30, end or now
    start = start or 0
    rows = O.of_version(O.run_window(O.app_jobs(jobs, cluster, user, app), start, end), version)
    picked = O.newest_flows(rows, max(limit, 1))
    if "conf" in picked.columns and (conf_keys or conf_patterns):
        keep = C.keys_in(conf_keys) if conf_keys else C.keys_matching(conf_patterns)
        picked = picked.withColumn("conf", C.filter_keys(F.col("conf"), keep))
    return picked


def flow_details(
    jobs: DataFrame, cluster: str, user: str, app: str, limit: int = 1, version: str | None = None,
    start: int | None = None, end: int = 0, now: int | None = None, include_jobs: bool = False,
) -> DataFrame:
    """Newest flows of an application with their sums; with ``include_jobs`` one row per job, the flow's sums on each.

    The same flows as :func:`flow_series`. Sums are over the jobs that pass the version filter.
    """
    picked = flow_series(jobs, cluster, user, app, limit, version, start, end, now)
    sums = O.rank_flows(O.roll_up(picked.drop("flow_rank")), max(limit, 1))
    if not include_jobs:
        return sums.select("flow_rank", *FLOW_SUMMARY, *O.SOLO)
    return flows_with_jobs(sums, picked.drop("flow_rank"))


def flow_stats_with_jobs(jobs: DataFrame, cluster: str, user: str, app: str, limit: int = 100, **window) -> DataFrame:
    """Page of flow statistics with the jobs of each flow, one row per job; the row behind the page is left out."""
    page = O.flow_stats_page(jobs, cluster, user, app, limit, **window).where("NOT is_next")
    return flows_with_jobs(page, O.app_jobs(jobs, cluster, user, app))


def flow_stats(jobs: DataFrame, cluster: str, user: str, app: str, limit: int = 100, **window) -> DataFrame:
    """Page of flow statistics; see :func:`runledger.operators.flows.flow_stats_page`."""
    paged = O.flow_stats_page(jobs, cluster, user, app, limit, **window)
    return paged.select(*FLOW_SUMMARY, *O.SOLO, "page_row", "is_next")


def app_versions(versions: DataFrame, cluster: str, user: str, app: str) -> DataFrame:
    return apps.versions_of(versions, cluster, user, app)


def cluster_of(clusters: DataFrame, host: str) -> DataFrame:
    """Cluster of one host; ``clusters`` is the (host, cluster) table."""
    if not host.strip():
        raise ValueError("a host is needed")
    return clusters.filter(F.col("host") == host).select("cluster")


def storage_snapshot(
    usage: DataFrame, cluster: str, now: int, run_id: int = 0, path: str | None = None, limit: int | None = None
) -> DataFrame:
    """Usage of one hour. Without an hour: two hours before ``now``, or the newest before that."""
    if run_id:
        return S.snapshot(usage, cluster, run_id, path, limit)
    return S.snapshot_as_of(usage, cluster, now - 2 * T.HOUR_SECONDS, path, limit=limit)


def storage_series(
    usage: DataFrame, cluster: str, path: str, now: int, start: int = 0, end: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Usage of one path, by default over the week before ``now``; ``start`` is the newer bound."""
    if not path:
        raise ValueError("a path is needed")
    newer = start or now
    return S.series(usage, cluster, path, newer, end or newer - WEEK_SECONDS, limit)


def _last_day(now: int, start: int, end: int, step: int) -> tuple[int, int]:
    """The given bounds; missing ones become the day before ``now``, cut down to a step."""
    return start or (now - T.DAY_MILLIS) // step * step, end or now // step * step


def new_apps(
    versions: DataFrame, jobs: DataFrame, cluster: str, now: int, user: str | None = None,
    start: int = 0, end: int = 0, limit: int | None = None,
) -> DataFrame:
    """Applications first seen in the window, by default the day before ``now``."""
    start, end = _last_day(now, start, end, NEW_APPS_STEP_MILLIS)
    return at_detail(apps.new_app_summaries(versions, jobs, start, end, cluster, user, limit), "new_apps")


def all_apps(
    daily: DataFrame, cluster: str, now: int, user: str | None = None, start: int = 0, end: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """All applications of a day range, by default the day before ``now``."""
    start, end = _last_day(now, start, end, HOUR_MILLIS)
    return at_detail(apps.all_apps(daily, cluster, start, end, user, limit), "all_apps")
