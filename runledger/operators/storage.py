"""Storage usage by cluster, path and hour (epoch seconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import times as T
from ..functions.ids import cleanse_token

COUNTS = [
    "file_count", "dir_count", "space_consumed", "access_count", "quota", "space_quota",
    "tmp_file_count", "tmp_space_consumed", "trash_file_count", "trash_space_consumed",
]
COSTS = ["access_cost", "storage_cost"]
PATH_KEY = ["cluster", "path", "run_id"]
DAY_SECONDS = 86_400
DEFAULT_HORIZON_DAYS = 528


def write_usage(usage: DataFrame, root: str, mode: str = "append") -> None:
    """Usage rows by UTC day of their hour, sorted by cluster and path within a file."""
    dated = usage.withColumn("day", F.col("run_id") - F.pmod(F.col("run_id"), F.lit(DAY_SECONDS)))
    dated.hint("rebalance", "day").sortWithinPartitions("day", "cluster", "path").write.mode(mode).partitionBy("day").parquet(root)


def hours(usage: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of the hours from ``first`` to ``last``. A table by days (see :func:`write_usage`) is read in the folders of these days only."""
    rows = usage.filter(F.col("run_id").between(first, last))
    if "day" in usage.columns:
        rows = rows.filter(F.col("day").between(first - first % DAY_SECONDS, last))
    return rows


def newest_cells(rows: DataFrame, key: list[str], write_order: list[str], keep: int = 1) -> DataFrame:
    """The newest ``keep`` versions of every key. Map tasks cut to ``keep`` rows per key first."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in write_order])
    return rows.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= keep).drop("_age")


def merge_namespaces(usage: DataFrame) -> DataFrame:
    """Namespaces of a path summed; the owner is the one of the last namespace."""
    return usage.groupBy(*PATH_KEY).agg(
        *[F.sum(F.coalesce(c, F.lit(0).cast("bigint"))).alias(c) for c in COUNTS],
        *[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in COSTS],
        F.max_by(F.coalesce("owner", F.lit("")), F.coalesce("namespace", F.lit(""))).alias("owner"),
    ).withColumn("hdfs_cost", F.col("access_cost") + F.col("storage_cost"))


def _under(usage: DataFrame, cluster: str | None, path_prefix: str | None) -> DataFrame:
    rows = usage if cluster is None else usage.filter(F.col("cluster") == cluster)
    if path_prefix:
        rows = rows.filter(F.col("path").startswith(cleanse_token(F.lit(path_prefix))))
    return rows


def snapshot(
    usage: DataFrame, cluster: str | None, run_id: int, path_prefix: str | None = None, limit: int | None = None
) -> DataFrame:
    """Usage of one hour; the limit counts merged paths."""
    hour = run_id - run_id % T.HOUR_SECONDS
    merged = merge_namespaces(hours(_under(usage, cluster, path_prefix), hour, hour))
    return merged if limit is None else order(merged).limit(limit)


def snapshot_as_of(
    usage: DataFrame,
    cluster: str | None,
    asked: int,
    path_prefix: str | None = None,
    horizon_days: int = DEFAULT_HORIZON_DAYS,
    limit: int | None = None,
) -> DataFrame:
    """Usage of the newest hour at or before the asked one that holds any, per cluster."""
    hour = asked - asked % T.HOUR_SECONDS
    rows = hours(_under(usage, cluster, path_prefix), hour - horizon_days * DAY_SECONDS, hour)
    # one row per cluster
    newest = rows.groupBy("cluster").agg(F.max("run_id").alias("run_id"))
    merged = merge_namespaces(rows.join(newest, ["cluster", "run_id"], "left_semi"))
    return merged if limit is None else order(merged).limit(limit)


def series(
    usage: DataFrame, cluster: str | None, path: str, newer: int, older: int, limit: int | None = None
) -> DataFrame:
    """Usage of one path, newest hour first; ``newer`` and ``older`` bound the hours."""
    if older > newer:
        raise ValueError(f"end time {older} must be older than start time {newer}")
    rows = hours(_under(usage, cluster, None), older, newer).filter(F.lower("path") == F.lower(cleanse_token(F.lit(path))))
    merged = merge_namespaces(rows)
    return merged if limit is None else order(merged).limit(limit)


def order(stats: DataFrame) -> DataFrame:
    return stats.orderBy("cluster", "path", F.col("run_id").desc())
