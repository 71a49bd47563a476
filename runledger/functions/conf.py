"""Job configuration maps: lookups, users, queues, key filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Configuration keys.
USER_KEYS = ["mapreduce.job.user.name", "user.name"]
QUEUE_KEYS = ["mapreduce.job.queuename", "mapred.fairscheduler.pool", "mapred.job.queue.name"]
DEFAULT_QUEUE = "DEFAULT_QUEUE"
RESOURCE_MANAGER_KEY = "yarn.resourcemanager.address"
JOB_TRACKER_KEY = "mapred.job.tracker"


def value(conf: Column, key: str) -> Column:
    return F.try_element_at(conf, F.lit(key))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def has_value(conf: Column, key: str) -> Column:
    return ~is_blank(value(conf, key))


def first_value(conf: Column, keys: list[str]) -> Column:
    """Value of the first key that holds a non-blank one."""
    picks = [F.when(~is_blank(value(conf, k)), value(conf, k)) for k in keys]
    return F.coalesce(*picks)


def long_value(conf: Column, key: str, default: int | Column) -> Column:
    """A whole number; the default when the key is missing, null when it is malformed."""
    text = F.trim(value(conf, key))
    fallback = default if isinstance(default, Column) else F.lit(default)
    number = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.when(text.isNull(), fallback.cast("bigint")).otherwise(number)


def long_is_malformed(conf: Column, key: str) -> Column:
    return value(conf, key).isNotNull() & long_value(conf, key, 0).isNull()


def user_name(conf: Column) -> Column:
    """Submitting user; null (an error for that job) when the conf names none."""
    return first_value(conf, USER_KEYS)


def conf_queue(conf: Column) -> Column:
    return F.coalesce(first_value(conf, QUEUE_KEYS), F.lit(DEFAULT_QUEUE))


def queue(conf: Column, user: Column) -> Column:
    """Queue to store; the literal value ``default`` stands for the user's own queue."""
    named = conf_queue(conf)
    return F.when(F.lower(named) == "default", user).otherwise(named)


def tracker_host(conf: Column) -> Column:
    """Host of the resource manager, else the job tracker, without its port."""
    return F.substring_index(
        F.coalesce(value(conf, RESOURCE_MANAGER_KEY), value(conf, JOB_TRACKER_KEY)), ":", 1
    )


# --- conf key filters; any Callable[[Column], Column] on the key will do ------------------


def filter_keys(conf: Column, keep: Callable[[Column], Column]) -> Column:
    return F.map_filter(conf, lambda k, _: keep(k))


def keys_in(names: list[str]) -> Callable[[Column], Column]:
    return lambda k: k.isin(*names) if names else F.lit(False)


def keys_matching(patterns: list[str]) -> Callable[[Column], Column]:
    """Keys that one of the regular expressions matches in full."""

    def keep(k: Column) -> Column:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | k.rlike(f"^(?:{p})$")
        return hit

    return keep


def wide_to_map(columns: dict[str, Column]) -> Column:
    """Conf held as one column per key, back to a map without the missing keys."""
    pairs = [F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in columns.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
