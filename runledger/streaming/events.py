"""Run events and run status as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import EVENT_KEY, STATUS_KEY, last_write_wins


def start_events(events: DataFrame, path: str, checkpoint: str, order: str = "write_seq", once: bool = True) -> StreamingQuery:
    """Appends events, one folder per micro-batch; of several writes of one event in a micro-batch
    the last by ``order``. No state is kept and no event is too late."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last_write_wins(batch, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stored_events(spark: SparkSession, path: str, order: str = "write_seq") -> DataFrame:
    """The appended events, each as it was written last."""
    rows = spark.read.parquet(path).withColumn(order, F.struct(order, "batch"))
    return last_write_wins(rows, order).drop(order, "batch")


def follow(events: DataFrame, cluster: str, flow_id, since: int) -> DataFrame:
    """Events of one flow behind a sequence, as they arrive."""
    return events.filter(
        (F.col("cluster") == cluster) & (F.col("flow_id") == flow_id) & (F.col("sequence") > since)
    )


def current_status(updates: DataFrame) -> DataFrame:
    """Running latest status row of every flow (update mode).

    The key time of a flow does not change when its status does, so updates are ordered by
    their own sequence.
    """
    rest = [c for c in updates.columns if c not in STATUS_KEY]
    latest = updates.groupBy(*STATUS_KEY).agg(F.max_by(F.struct(*rest), "update_seq").alias("row"))
    return latest.select(*STATUS_KEY, "row.*")
