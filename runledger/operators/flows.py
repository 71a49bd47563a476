"""Flows: all jobs of one run of an application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import APP_KEY, FLOW_KEY, is_job
from .ordering import page

SUMS = [
    "total_maps", "total_reduces", "hdfs_bytes_read", "hdfs_bytes_written", "reduce_shuffle_bytes",
    "map_file_bytes_read", "map_file_bytes_written", "reduce_file_bytes_read", "map_slot_millis",
    "reduce_slot_millis", "mb_millis",
]
COUNTER_KINDS = {"total": "counters", "map": "map_counters", "reduce": "reduce_counters"}

# A job without a run id is a flow of its own; its own id then completes the flow key.
SOLO = ["solo_epoch", "solo_seq"]


def _solo_parts() -> dict[str, Column]:
    alone = F.col("run_id") == 0
    zero = F.lit(0).cast("bigint")
    return {
        "solo_epoch": F.when(alone, F.col("job_epoch")).otherwise(zero),
        "solo_seq": F.when(alone, F.col("job_seq")).otherwise(zero),
    }


def with_solo(jobs: DataFrame) -> DataFrame:
    """Jobs with the two columns that complete the flow key of a job without a run id."""
    return jobs.withColumns(_solo_parts())


def app_jobs(jobs: DataFrame, cluster: str, user: str, app: str) -> DataFrame:
    return jobs.filter((F.col("cluster") == cluster) & (F.col("user_name") == user) & (F.col("app_id") == app))


def flow_jobs(jobs: DataFrame, cluster: str, user: str, app: str, run_id: int) -> DataFrame:
    return app_jobs(jobs, cluster, user, app).filter(F.col("run_id") == run_id)


def run_window(rows: DataFrame, start: int = 0, end: int = 0) -> DataFrame:
    """Runs with start < run_id <= end; 0 leaves a side open."""
    if start:
        rows = rows.filter(F.col("run_id") > start)
    if end:
        rows = rows.filter(F.col("run_id") <= end)
    return rows


def of_version(rows: DataFrame, version: str | None) -> DataFrame:
    """Rows of one version; rows without a version pass too."""
    if not version:
        return rows
    return rows.filter(F.col("version").isNull() | (F.col("version") == version))


def _set_min(column: str) -> Column:
    """Smallest value that is set; 0 stands for unset."""
    return F.coalesce(F.min(F.when(F.col(column) != 0, F.col(column))), F.lit(0).cast("bigint"))


def roll_up(jobs: DataFrame) -> DataFrame:
    """One row per flow: sums, times, queue and log version of its first job, version of its last.

    Every aggregate combines on the map side, so a flow with most of the jobs costs no more
    than one row per map task in the shuffle.
    """
    position = [F.col("job_epoch"), F.col("job_seq")]
    submitted = F.struct(F.col("submit_time") == 0, F.col("submit_time"), *position)
    return (
        jobs.withColumns(_solo_parts())
        .groupBy(*FLOW_KEY, *SOLO)
        .agg(
            F.count("*").alias("job_count"),
            *[F.sum(c).alias(c) for c in SUMS],
            F.sum("cost").alias("cost"),
            _set_min("submit_time").alias("submit_time"),
            _set_min("launch_time").alias("launch_time"),
            F.max("finish_time").alias("finish_time"),
            F.min_by("history_version", submitted).alias("history_version"),
            F.min_by("queue", submitted).alias("queue"),
            F.max_by("version", F.struct(*position)).alias("version"),
        )
        .withColumns(
            {
                "duration": F.col("finish_time") - F.col("launch_time"),
                "wall_clock_time": F.col("finish_time") - F.col("submit_time"),
            }
        )
    )


def explode_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counter maps to rows (keys, kind, counter_group, counter_name, value)."""
    kinds = F.create_map(*[x for k, c in COUNTER_KINDS.items() for x in (F.lit(k), F.col(c))])
    by_kind = rows.select(*keys, F.explode(kinds).alias("kind", "groups"))
    by_group = by_kind.select(*keys, "kind", F.explode("groups").alias("counter_group", "cells"))
    return by_group.select(*keys, "kind", "counter_group", F.explode("cells").alias("counter_name", "value"))


def counter_sums(jobs: DataFrame) -> DataFrame:
    """Counter sums per flow."""
    keyed = jobs.withColumns(_solo_parts())
    return sum_counters(explode_counters(keyed, [*FLOW_KEY, *SOLO]), [*FLOW_KEY, *SOLO])


def sum_counters(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.groupBy(*keys, "kind", "counter_group", "counter_name").agg(F.sum("value").alias("value"))


def _newest_first() -> list[Column]:
    return [F.col("run_id").desc(), F.col("solo_epoch"), F.col("solo_seq")]


def rank_flows(flows: DataFrame, limit: int) -> DataFrame:
    """The newest flows of each application with their rank.

    The rank filter lets Spark cut every map task down to ``limit`` flows per application
    before the shuffle, so an application with most of the flows does not fill one task.
    """
    rank = F.row_number().over(Window.partitionBy(*APP_KEY).orderBy(*_newest_first()))
    return flows.withColumn("flow_rank", rank.cast("bigint")).filter(F.col("flow_rank") <= limit)


def newest_flows(jobs: DataFrame, limit: int) -> DataFrame:
    """All jobs of the newest ``limit`` flows per application, with ``flow_rank``.

    Ranks the distinct flow keys, not the jobs, and joins the jobs back.
    """
    keyed = jobs.withColumns(_solo_parts())
    flow_keys = [*FLOW_KEY, *SOLO]
    ranked = rank_flows(keyed.select(*flow_keys).distinct(), limit)
    return keyed.join(ranked, flow_keys).select(*jobs.columns, "flow_rank")


def newest_flow_summaries(jobs: DataFrame, limit: int) -> DataFrame:
    """Roll-ups of the newest ``limit`` flows per application, with ``flow_rank``."""
    return rank_flows(roll_up(jobs), limit)


def latest_flow(jobs: DataFrame, cluster: str, user: str, app: str) -> DataFrame:
    return newest_flow_summaries(app_jobs(jobs, cluster, user, app), 1)


def flow_of_job(jobs: DataFrame, cluster: str | None, job_id: str) -> DataFrame:
    """All jobs of the flow one job belongs to; without a cluster, in every cluster that knows it.

    The flow key comes from the rows of that job alone. A job without a run id is a flow of its own.
    """
    keyed = jobs.withColumns(_solo_parts())
    one = keyed.filter(is_job(job_id))
    if cluster is not None:
        one = one.filter(F.col("cluster") == cluster)
    return keyed.join(one.select(*FLOW_KEY, *SOLO), [*FLOW_KEY, *SOLO], "left_semi").select(*jobs.columns)


def jobs_with_tasks(jobs: DataFrame, tasks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per job and task; jobs without tasks stay with null task columns.

    The inner part may split a job that holds most of the tasks over many reducers; a left
    join could not split that side. Jobs without tasks come from an anti join against the
    distinct task keys.
    """
    key = key or ["cluster", "job_id"]
    matched = jobs.join(tasks, key)
    idle = jobs.join(tasks.select(*key).distinct(), key, "left_anti")
    return matched.unionByName(idle, allowMissingColumns=True)


def flow_stats_page(
    jobs: DataFrame,
    cluster: str,
    user: str,
    app: str,
    limit: int,
    version: str | None = None,
    start: int = 0,
    end: int = 0,
    start_key: tuple[int, int, int] | None = None,
) -> DataFrame:
    """A page of flow statistics, newest first; never touches the conf column.

    ``start_key`` is the (run_id, solo_epoch, solo_seq) the page begins with; a limit of 0 gives
    all flows as one page.
    """
    rows = of_version(run_window(app_jobs(jobs, cluster, user, app), start, end), version)
    at = None
    if start_key is not None:
        run_id, *solo = start_key
        behind = F.struct(*SOLO) >= F.struct(*[F.lit(x).cast("bigint").alias(c) for c, x in zip(SOLO, solo)])
        at = (F.col("run_id") < run_id) | ((F.col("run_id") == run_id) & behind)
    return page(roll_up(rows), _newest_first(), limit, at)


def order_newest_first(flows: DataFrame) -> DataFrame:
    return flows.orderBy(*APP_KEY, F.col("run_id").desc())
