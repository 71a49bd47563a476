"""Job ids, task keys and key tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

JOB_KEY = ["cluster", "user_name", "app_id", "run_id", "job_epoch", "job_seq"]
FLOW_KEY = ["cluster", "user_name", "app_id", "run_id"]
APP_KEY = ["cluster", "user_name", "app_id"]


def _id_part(job_id: Column, position: int) -> Column:
    part = F.try_element_at(F.split(F.trim(job_id), "_"), F.lit(position))
    return F.when(part.rlike(r"^[+-]?[0-9]+$"), part.try_cast("bigint"))


def job_epoch(job_id: Column) -> Column:
    """Epoch part of ``job_<epoch>_<seq>``; null when the id is malformed."""
    return F.when(_id_part(job_id, 3).isNotNull(), _id_part(job_id, 2))


def job_seq(job_id: Column) -> Column:
    """Sequence part of ``job_<epoch>_<seq>``; null when the id is malformed."""
    return F.when(_id_part(job_id, 2).isNotNull(), _id_part(job_id, 3))


def job_id_string(epoch: Column, seq: Column) -> Column:
    """``job_<epoch>_<seq>`` with at least four digits for the sequence."""
    # format_string is many times slower than this; it is only needed for a sign among the zeros
    digits = seq.cast("string")
    padded = (
        F.when(seq < 0, F.format_string("%04d", seq))
        .when(seq < 10000, F.lpad(digits, 4, "0"))
        .otherwise(digits)
    )
    return F.concat(F.lit("job_"), epoch.cast("string"), F.lit("_"), padded)


def is_job(job_id: str) -> Column:
    """Rows of one job. For a well-formed id its numbers are compared too: unlike the id text,
    which views work out, they reach the scan of the tables below."""
    same = F.col("job_id") == job_id
    parts = re.fullmatch(r"[^_]+_([+-]?[0-9]+)_([+-]?[0-9]+)", job_id.strip())
    if not parts:
        return same
    epoch, seq = (F.lit(int(n)).cast("bigint") for n in parts.groups())
    return same & (F.col("job_epoch") == epoch) & (F.col("job_seq") == seq)


def require_job_id(job_id: Column) -> Column:
    """The id itself, or a failing row for callers that want malformed ids to be fatal."""
    bad = F.concat(F.lit("Invalid job id: "), F.coalesce(job_id, F.lit("null")))
    return F.when(job_seq(job_id).isNotNull(), job_id).otherwise(F.raise_error(bad).cast("string"))


def cleanse_token(token: Column) -> Column:
    """Blanks and exclamation marks, reserved in keys, become underscores."""
    return F.translate(token, " !", "__")


def key_token(value: Column) -> Column:
    """Key component: missing reads as empty, outer blanks dropped."""
    return F.coalesce(F.trim(value), F.lit(""))


def task_component(prefix: str, job_id: Column, full_id: Column) -> Column:
    """Task or attempt id without its ``<prefix><job number>_`` head."""
    number = F.when(
        job_id.startswith("job_") & (F.length(job_id) > 4), F.substring(job_id, 5, 1 << 30)
    ).otherwise(F.lit(""))
    head = F.concat(F.lit(prefix), number, F.lit("_"))
    tail = full_id.substr(F.length(head) + 1, F.length(full_id))
    return (
        F.when(full_id.isNull(), F.lit(""))
        .when(full_id.startswith(head) & (F.length(full_id) > F.length(head)), tail)
        .otherwise(full_id)
    )


def am_component(attempt_id: Column) -> Column:
    return F.concat(F.lit("AM_"), F.coalesce(attempt_id, F.lit("")))
