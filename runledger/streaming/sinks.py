"""Draining a stream into written tables.

Every micro-batch overwrites its own folder, so a repeated batch leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import new_work_path


def start_append(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append-mode rows to a parquet table with exactly-once files."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def start_updates(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Update-mode rows, one folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest update of every key of an update table."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")


def drain_append(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    path = new_work_path(spark, label)
    start_append(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def drain_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    spark = stream.sparkSession
    path = new_work_path(spark, label)
    start_updates(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return latest_updates(spark.read.parquet(f"{path}/table"), keys)
