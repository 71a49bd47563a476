"""Job and task rows: look-ups, projections, repair lists, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import counters as K, defaults as D
from ..functions.ids import JOB_KEY, is_job

# The counters job statistics come from, by history version.
STAT_COUNTERS = {
    "map_file_bytes_read": ("map_counters", "file", "FILE_BYTES_READ"),
    "map_file_bytes_written": ("map_counters", "file", "FILE_BYTES_WRITTEN"),
    "reduce_file_bytes_read": ("reduce_counters", "file", "FILE_BYTES_READ"),
    "hdfs_bytes_read": ("counters", "file", "HDFS_BYTES_READ"),
    "hdfs_bytes_written": ("counters", "file", "HDFS_BYTES_WRITTEN"),
    "map_slot_millis": ("counters", "job", "SLOTS_MILLIS_MAPS"),
    "reduce_slot_millis": ("counters", "job", "SLOTS_MILLIS_REDUCES"),
    "reduce_shuffle_bytes": ("reduce_counters", "task", "REDUCE_SHUFFLE_BYTES"),
}
GROUPS_ONE = {
    "file": "FileSystemCounters",
    "job": "org.apache.hadoop.mapred.JobInProgress$Counter",
    "task": "org.apache.hadoop.mapred.Task$Counter",
}
GROUPS_TWO = {
    "file": "org.apache.hadoop.mapreduce.FileSystemCounter",
    "job": "org.apache.hadoop.mapreduce.JobCounter",
    "task": "org.apache.hadoop.mapreduce.TaskCounter",
}
TASK_COUNTS = [
    "total_maps", "total_reduces", "finished_maps", "finished_reduces", "failed_maps", "failed_reduces",
]


def job_by_id(jobs: DataFrame, cluster: str, job_id: str) -> DataFrame:
    return jobs.filter((F.col("cluster") == cluster) & is_job(job_id))


def tasks_of_job(tasks: DataFrame, cluster: str, job_id: str) -> DataFrame:
    return tasks.filter((F.col("cluster") == cluster) & is_job(job_id))


def stat_expressions() -> dict[str, Column]:
    """Job statistics from the counter maps; the history version decides the group names."""
    is_two = F.col("history_version") == "TWO"
    return {
        name: F.when(is_two, K.value(F.col(source), GROUPS_TWO[group], counter)).otherwise(
            K.value(F.col(source), GROUPS_ONE[group], counter)
        )
        for name, (source, group, counter) in STAT_COUNTERS.items()
    }


def job_details(jobs: DataFrame) -> DataFrame:
    """Job rows with missing values defaulted and statistics taken from the counters."""
    numbers = {c: D.long_or_zero(F.col(c)) for c in [*TASK_COUNTS, "submit_time", "launch_time", "finish_time", "mb_millis"]}
    texts = {c: D.text_or_empty(F.col(c)) for c in ["job_status", "version", "queue"]}
    return jobs.withColumns(
        {**numbers, **texts, "cost": D.double_or_zero(F.col("cost")), **stat_expressions()}
    ).withColumn("run_time", F.col("finish_time") - F.col("launch_time"))


def task_details(tasks: DataFrame) -> DataFrame:
    """Task rows with missing values defaulted and the split hosts as an array."""
    longs = ["start_time", "finish_time", "shuffle_finished", "sort_finished"]
    texts = ["task_type", "task_status", "task_attempt_id", "hostname", "tracker_name", "state_string", "error"]
    return tasks.withColumns(
        {
            **{c: D.long_or_zero(F.col(c)) for c in longs if c in tasks.columns},
            **{c: D.text_or_empty(F.col(c)) for c in texts if c in tasks.columns},
            "splits": F.when(F.coalesce("splits", F.lit("")) == "", F.array().cast("array<string>")).otherwise(
                F.split("splits", ",")
            ),
        }
    )


def jobs_of_framework(
    jobs: DataFrame, framework: str, columns: list[str], start: int | None = None, end: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Jobs of a framework with start <= submit_time < end; rows without the values drop out."""
    rows = jobs.filter(F.col("framework") == framework)
    if start is not None:
        rows = rows.filter(F.col("submit_time") >= start)
    if end is not None:
        rows = rows.filter(F.col("submit_time") < end)
    if limit is not None and limit > 0:
        rows = rows.orderBy(*JOB_KEY).limit(limit)
    return rows.select(*columns)


def _missing(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def partial_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(_missing("job_id"))


def partial_raw(raw: DataFrame) -> DataFrame:
    """Raw rows whose conf or history blob is missing or empty."""

    def absent(column: str) -> Column:
        return F.col(column).isNull() | (F.octet_length(column) == 0)

    return raw.filter(absent("conf") | absent("history"))


def removal(jobs: DataFrame, tasks: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs and tasks that stay when ``doomed`` (cluster, job_id) goes, and the rows removed per job."""
    key = ["cluster", "job_id"]
    doomed = doomed.select(*key).distinct()
    gone = (
        jobs.select(*key, F.lit(1).alias("n"))
        .unionByName(tasks.select(*key, F.lit(1).alias("n")))
        .join(doomed, key, "left_semi")
        .groupBy(*key)
        .agg(F.sum("n").alias("rows_removed"))
    )
    return jobs.join(doomed, key, "left_anti"), tasks.join(doomed, key, "left_anti"), gone


def cluster_of_host(hosts: DataFrame, clusters: DataFrame, host: str = "host") -> DataFrame:
    """Adds the cluster a host belongs to; ``clusters`` is the (host, cluster) table.

    No broadcast hint: Catalyst broadcasts the table while its size allows it.
    """
    return hosts.join(clusters.select(F.col("host").alias(host), F.col("cluster")), host, "left")


def with_cost(jobs: DataFrame, rates: DataFrame, machine_type: str = "machine_type") -> DataFrame:
    """Adds ``cost`` from the (machine_type, compute_cost, machine_memory) table; unknown types cost 0."""
    from ..functions.cost import job_cost

    table = rates.select(
        F.col("machine_type").alias(machine_type), F.col("compute_cost").alias("_rate"),
        F.col("machine_memory").alias("_memory"),
    )
    priced = jobs.join(table, machine_type, "left")
    return priced.withColumn("cost", job_cost(F.col("mb_millis"), F.col("_rate"), F.col("_memory"))).drop(
        "_rate", "_memory"
    )
