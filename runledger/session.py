"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# SQL settings every query relies on. All of them can be set on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a counter or conf name that occurs twice in one record keeps its last value
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "runledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints and written intermediate tables.

    Where none is named, a folder below the warehouse serves: like the tables
    themselves, all executors see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    below = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    spark.sparkContext.setCheckpointDir(below)
    return below


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def new_work_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder, for one written table or stream checkpoint."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
