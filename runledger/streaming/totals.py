"""Running day and week totals per application.

No job is too late. The state of the totals is one row of sums per application and period; it grows with
the totals, not with the jobs. The state of distinct runs is one row per run of the last 30 days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.apps import PERIODS, TOTALS

MARK_DAYS = 30
KEYS = ["cluster", "period_start", "user_name", "app_id"]


def _placed(jobs: DataFrame, period: str) -> DataFrame:
    return jobs.withColumn("period_start", PERIODS[period](F.col("run_id")))


def running_totals(jobs: DataFrame, period: str) -> DataFrame:
    """Totals so far (update mode)."""
    return _placed(jobs, period).groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in TOTALS], F.count("*").alias("job_count"), F.sum("cost").alias("cost")
    )


def new_runs(jobs: DataFrame, period: str = "day", arrived: Column | None = None) -> DataFrame:
    """Every run of an application and period when its first job arrives (append mode).

    The state marks the runs that arrived in the last 30 days (``arrived``: the time of the micro-batch unless given,
    so no job is ever late). A job that comes after its run's mark has gone gives the run once more:
    the written rows are the marks of older runs, and :func:`run_counts` counts each run once.
    """
    key = [*KEYS, "run_id"]
    marked = _placed(jobs, period).withColumn("arrived", F.current_timestamp() if arrived is None else arrived)
    return marked.select(*key, "arrived").withWatermark("arrived", f"{MARK_DAYS} days").dropDuplicatesWithinWatermark(key).drop("arrived")


def run_counts(runs: DataFrame) -> DataFrame:
    """Number of runs, from the written rows of :func:`new_runs`."""
    return runs.groupBy(*KEYS).agg(F.countDistinct("run_id").alias("number_runs"))
