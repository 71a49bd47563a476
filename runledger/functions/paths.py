"""File names, storage paths and queue lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .conf import is_blank

# File name patterns.
JOB_FILE_PATTERN = r"^.*(job_[0-9]*_[0-9]*)[-_].*$"
CONF_FILE_PATTERN = r"^(.*)(conf.xml)$"
CHECKSUM_SUFFIX = ".crc"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_checksum(path: Column) -> Column:
    return path.endswith(CHECKSUM_SUFFIX)


def file_job_id(name: Column) -> Column:
    """Job id in a file name; null when the name belongs to no job."""
    named = (F.length(name) > 0) & ~is_checksum(name) & name.rlike(JOB_FILE_PATTERN)
    return F.when(named, F.regexp_extract(name, JOB_FILE_PATTERN, 1))


def file_kind(name: Column) -> Column:
    """``conf``, ``history`` or ``none``."""
    return (
        F.when(file_job_id(name).isNull(), F.lit("none"))
        .when(name.rlike(CONF_FILE_PATTERN), F.lit("conf"))
        .otherwise(F.lit("history"))
    )


def archive_parts(mod_time: Column) -> tuple[Column, Column, Column]:
    """Year, month and day folder of a file, from the UTC date it was last modified."""
    at = F.timestamp_millis(mod_time)
    return F.date_format(at, "yyyy"), F.date_format(at, "MM"), F.date_format(at, "dd")


def same_qualified_path(
    cluster: Column, path: Column, ns: Column, other_cluster: Column, other_path: Column, other_ns: Column
) -> Column:
    """Equal paths; the namespace counts only when the left side has one."""
    same_place = (cluster == other_cluster) & (path == other_path)
    return same_place & F.when(is_blank(ns), F.lit(True)).otherwise(F.coalesce(ns == other_ns, F.lit(False)))


def queue_list(queues: Column) -> Column:
    """Set of queues to the stored text, every name closed with ``!``."""
    return F.when(F.size(queues) == 0, F.lit("")).otherwise(
        F.concat(F.array_join(F.array_sort(queues), "!"), F.lit("!"))
    )


def queue_set(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), "!")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda q: F.trim(q) != "")))
