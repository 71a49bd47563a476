"""How each framework names its applications, runs and versions.

``DESCRIPTIONS`` maps a framework to the expression builders for its app name, run id and
version. A new framework is one more entry; nothing else has to change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from . import conf as C
from .ids import cleanse_token
from .times import MONTH_MILLIS, month_start

# Configuration keys and patterns.
APP_NAME_KEY = "batch.desc"
JOB_NAME_KEYS = ["mapred.job.name", "mapreduce.job.name"]
PIG_KEY = "pig.version"
PIG_SIGNATURE_KEY = "pig.logical.plan.signature"
PIG_RUN_KEY = "pig.script.submitted.timestamp"
PIG_LOG_KEY = "pig.logfile"
CASCADING_FLOW_KEY = "cascading.flow.id"
CASCADING_APP_KEY = "cascading.app.id"
SCALDING_SIGNATURE_KEY = "scalding.flow.class.signature"
SCALDING_RUN_KEY = "scalding.flow.submitted.timestamp"
MR_RUN_KEY = "mapred.app.submitted.timestamp"
PIG_LOG_PATTERN = r"^.*pig_([0-9]*).log$"
PIG_SCHEDULED_PATTERN = r"^PigLatin:([^:]*(:.*?)+)_([0-9]{4})/.*$"
PIG_SCHEDULED_PREFIX = "oink "
SCALDING_BRACKETS_PATTERN = r"\[.*\]\s*"
SCALDING_SEQUENCE_PATTERN = r"^(.*)/\(\d+/\d+\).*$"


def framework(conf: Column) -> Column:
    return (
        F.when(C.value(conf, PIG_KEY).isNotNull(), F.lit("PIG"))
        .when(F.coalesce(C.value(conf, CASCADING_FLOW_KEY), F.lit("")) != "", F.lit("SCALDING"))
        .otherwise(F.lit("NONE"))
    )


# --- app names ----------------------------------------------------------------------------


def mr_app_name(job_name: Column) -> Column:
    return F.substring_index(job_name, "[", 1)


def pig_app_name(job_name: Column) -> Column:
    scheduled = F.regexp_extract(job_name, PIG_SCHEDULED_PATTERN, 1)
    return F.when(
        job_name.rlike(PIG_SCHEDULED_PATTERN), F.concat(F.lit(PIG_SCHEDULED_PREFIX), scheduled)
    ).otherwise(job_name)


def scalding_app_name(job_name: Column) -> Column:
    bare = F.regexp_replace(job_name, SCALDING_BRACKETS_PATTERN, "")
    return F.when(
        bare.rlike(SCALDING_SEQUENCE_PATTERN), F.regexp_extract(bare, SCALDING_SEQUENCE_PATTERN, 1)
    ).otherwise(bare)


def named_app(conf: Column, from_job_name: Callable[[Column], Column]) -> Column:
    """Explicit description, else the old job name, else the new one; cleansed, never null."""
    explicit = C.value(conf, APP_NAME_KEY)
    old, new = (C.value(conf, k) for k in JOB_NAME_KEYS)
    picked = (
        F.when(~C.is_blank(explicit), explicit)
        .when(~C.is_blank(old), from_job_name(old))
        .when(~C.is_blank(new), from_job_name(new))
        .otherwise(new)
    )
    return F.coalesce(cleanse_token(picked), F.lit(""))


def scalding_app(conf: Column) -> Column:
    named = named_app(conf, scalding_app_name)
    fallback = F.coalesce(cleanse_token(C.value(conf, CASCADING_APP_KEY)), F.lit(""))
    return F.when(named == "", fallback).otherwise(named)


# --- run ids ------------------------------------------------------------------------------


def mr_run_id(conf: Column, submit_time: Column) -> Column:
    return C.long_value(conf, MR_RUN_KEY, submit_time)


def pig_log_time(log_name: Column) -> Column:
    digits = F.regexp_extract(log_name, PIG_LOG_PATTERN, 1)
    return F.when(~log_name.rlike(PIG_LOG_PATTERN), F.lit(0).cast("bigint")).otherwise(
        digits.try_cast("bigint")
    )


def pig_run_id(conf: Column, submit_time: Column) -> Column:
    stamped = C.long_value(conf, PIG_RUN_KEY, 0)
    log_name = C.value(conf, PIG_LOG_KEY)
    return (
        F.when(stamped.isNull() | (stamped != 0), stamped)
        .when(log_name.isNull(), submit_time)
        .otherwise(pig_log_time(log_name))
    )


def hashed_run_id(flow_id: Column, submit_time: Column) -> Column:
    """A run id all jobs of a flow share: part of the flow hash, kept inside the month."""
    head = F.substring(flow_id, 1, 16)
    # without the guard conv() would turn a non-hex head into 0
    number = F.when(head.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(head, 16, 10).try_cast("bigint"))
    return F.coalesce(month_start(submit_time) + F.call_function("mod", number, F.lit(MONTH_MILLIS)), submit_time)


def scalding_run_id(conf: Column, submit_time: Column) -> Column:
    stamped = C.long_value(conf, SCALDING_RUN_KEY, 0)
    flow_id = C.value(conf, CASCADING_FLOW_KEY)
    return (
        F.when(stamped.isNull() | (stamped != 0), stamped)
        .when(F.coalesce(flow_id, F.lit("")) != "", hashed_run_id(flow_id, submit_time))
        .otherwise(submit_time)
    )


# --- versions and the strategy table --------------------------------------------------------


def _signature(key: str) -> Callable[[Column], Column]:
    return lambda conf: F.coalesce(F.trim(C.value(conf, key)), F.lit(""))


@dataclass(frozen=True)
class Description:
    app_id: Callable[[Column], Column]
    run_id: Callable[[Column, Column], Column]
    version: Callable[[Column], Column]


DESCRIPTIONS = {
    "PIG": Description(lambda c: named_app(c, pig_app_name), pig_run_id, _signature(PIG_SIGNATURE_KEY)),
    "SCALDING": Description(scalding_app, scalding_run_id, _signature(SCALDING_SIGNATURE_KEY)),
    "NONE": Description(lambda c: named_app(c, mr_app_name), mr_run_id, lambda c: F.lit("")),
}


def _by_framework(fw: Column, build: Callable[[Description], Column]) -> Column:
    out = build(DESCRIPTIONS["NONE"])
    for name, description in DESCRIPTIONS.items():
        if name != "NONE":
            out = F.when(fw == name, build(description)).otherwise(out)
    return out


def app_id(conf: Column, fw: Column) -> Column:
    return _by_framework(fw, lambda d: d.app_id(conf))


def run_id(conf: Column, fw: Column, submit_time: Column) -> Column:
    return _by_framework(fw, lambda d: d.run_id(conf, submit_time))


def version(conf: Column, fw: Column) -> Column:
    return _by_framework(fw, lambda d: d.version(conf))
