"""Applications: summaries, day and week totals, versions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import paths as P, times as T
from ..functions.ids import APP_KEY
from .flows import roll_up, run_window

PERIODS = {"day": T.day_floor, "week": T.week_floor}
TOTALS = ["total_maps", "total_reduces", "mb_millis", "map_slot_millis", "reduce_slot_millis"]


def summarize(flows: DataFrame) -> DataFrame:
    """App summary over flows; cost is not part of it."""
    set_run = F.when(F.col("run_id") != 0, F.col("run_id"))
    return flows.groupBy(*APP_KEY).agg(
        F.count("*").alias("number_runs"),
        F.sum("job_count").alias("job_count"),
        *[F.sum(c).alias(c) for c in TOTALS],
        P.queue_list(F.collect_set("queue")).alias("queues"),
        F.coalesce(F.min(set_run), F.lit(0).cast("bigint")).alias("first_run_id"),
        F.max("run_id").alias("last_run_id"),
    )


def period_totals(jobs: DataFrame, period: str) -> DataFrame:
    """Totals per application and UTC day or week of the run.

    Runs are counted exactly: Spark first reduces the rows to one per application, period and
    run, so an application with most of the jobs is spread over its runs.
    """
    return (
        jobs.withColumn("period_start", PERIODS[period](F.col("run_id")))
        .groupBy("cluster", "period_start", "user_name", "app_id")
        .agg(
            *[F.sum(c).alias(c) for c in TOTALS],
            F.count("*").alias("job_count"),
            F.countDistinct("run_id").alias("number_runs"),
            F.sum("cost").alias("cost"),
            P.queue_list(F.collect_set("queue")).alias("queues"),
        )
    )


def all_apps(
    daily: DataFrame, cluster: str | None, start: int, end: int, user: str | None = None, limit: int | None = None
) -> DataFrame:
    """Day rows merged per application; both days count. Limits only whole results."""
    start_day, end_day = start - start % T.DAY_MILLIS, end - end % T.DAY_MILLIS
    rows = daily.filter(F.col("period_start").between(start_day, end_day))
    if cluster is not None:
        rows = rows.filter(F.col("cluster") == cluster)
    if user:
        rows = rows.filter(F.col("user_name") == user)
    merged = rows.groupBy(*APP_KEY).agg(
        *[F.sum(c).alias(c) for c in [*TOTALS, "job_count", "number_runs", "cost"]],
        F.min("period_start").alias("first_day"),
        F.max("period_start").alias("last_day"),
        P.queue_list(F.array_distinct(F.flatten(F.collect_set(P.queue_set(F.col("queues")))))).alias("queues"),
    )
    if limit is None:
        return merged
    return merged.orderBy(F.col("last_day").desc(), "user_name", "app_id", "cluster").limit(limit)


def not_aggregated(jobs: DataFrame, aggregated: DataFrame, again: bool = False) -> DataFrame:
    """Jobs still to be added to the totals; ``again`` takes all of them."""
    if again:
        return jobs
    key = ["cluster", "job_id"]
    return jobs.join(aggregated.select(*key).distinct(), key, "left_anti")


# --- versions -------------------------------------------------------------------------------


def versions(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(*APP_KEY, "version").agg(F.min("run_id").alias("first_seen"))


def latest_version(app_versions: DataFrame) -> DataFrame:
    return app_versions.groupBy(*APP_KEY).agg(
        F.max_by("version", F.struct("first_seen", "version")).alias("version"),
        F.max("first_seen").alias("first_seen"),
    )


def versions_of(app_versions: DataFrame, cluster: str, user: str, app: str) -> DataFrame:
    """Versions of one application, newest first."""
    own = app_versions.filter(
        (F.col("cluster") == cluster) & (F.col("user_name") == user) & (F.col("app_id") == app)
    )
    return own.orderBy(F.col("first_seen").desc(), F.col("version").desc())


def new_apps(app_versions: DataFrame, start: int, end: int) -> DataFrame:
    """Applications first seen in [start, end]."""
    first = app_versions.groupBy(*APP_KEY).agg(F.min("first_seen").alias("first_seen"))
    return first.filter(F.col("first_seen").between(start, end))


def new_app_summaries(
    app_versions: DataFrame, jobs: DataFrame, start: int, end: int,
    cluster: str | None = None, user: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Summaries, over the flows in the window, of applications new in the window.

    Applications without a flow in the window stay, with zeros.
    """
    if cluster is not None:
        app_versions, jobs = (d.filter(F.col("cluster") == cluster) for d in (app_versions, jobs))
    if user:
        app_versions, jobs = (d.filter(F.col("user_name") == user) for d in (app_versions, jobs))
    fresh = new_apps(app_versions, start, end).select(*APP_KEY)
    if limit is not None:
        fresh = fresh.orderBy(*APP_KEY).limit(limit)
    # summaries shrink to one row per application before they meet the new ones
    seen = summarize(roll_up(run_window(jobs, start, end)))
    numbers = [c for c in seen.columns if c not in (*APP_KEY, "queues")]
    return fresh.join(seen, APP_KEY, "left").select(
        *APP_KEY,
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in numbers],
        F.coalesce("queues", F.lit("")).alias("queues"),
    )


# --- statistics -----------------------------------------------------------------------------


def statistics(
    jobs: DataFrame,
    columns: list[str],
    by_app: bool = False,
    framework: str | None = None,
    status: str | None = None,
    start: int | None = None,
    end: int | None = None,
    sort: str | None = None,
    limit: int = -1,
) -> DataFrame:
    """Column sums and job counts per user, or per user and application; optional top-k."""
    rows = jobs
    for name, wanted in (("framework", framework), ("job_status", status)):
        if wanted is not None:
            rows = rows.filter(F.col(name) == wanted)
    if start is not None:
        rows = rows.filter(F.col("submit_time") >= start)
    if end is not None:
        rows = rows.filter(F.col("submit_time") < end)
    keys = ["user_name", *(["app_id"] if by_app else [])]
    out = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("job_count"))
    if sort:
        out = out.orderBy(F.col(sort).desc(), *keys)
    return out.limit(limit) if limit >= 0 else out
