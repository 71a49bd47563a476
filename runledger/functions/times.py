"""Time arithmetic on epoch millis (epoch seconds for storage usage), always UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MILLIS = 86_400_000
MONTH_MILLIS = 30 * DAY_MILLIS
TYPICAL_JOB_MILLIS = 3_600_000
HOUR_SECONDS = 3_600


def millis(timestamp: Column) -> Column:
    """Epoch millis of a timestamp; zone-less ones are read as UTC (the session zone)."""
    return F.unix_millis(timestamp.cast("timestamp"))


def day_floor(ts: Column) -> Column:
    return ts - F.pmod(ts, F.lit(DAY_MILLIS))


def week_floor(ts: Column) -> Column:
    """Start of the week, Sunday. Epoch day 0 was a Thursday, four days after a Sunday."""
    day = F.call_function("div", day_floor(ts), F.lit(DAY_MILLIS))
    return (day - F.pmod(day + 4, F.lit(7))) * DAY_MILLIS


def hour_floor_seconds(seconds: Column) -> Column:
    return seconds - F.pmod(seconds, F.lit(HOUR_SECONDS))


def month_start(ts: Column) -> Column:
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(ts)))


def run_time(finish: Column, launch: Column) -> Column:
    """Job run time and flow duration."""
    return finish - launch


def wall_clock(finish: Column, submit: Column) -> Column:
    return finish - submit


def day_start_millis(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.unix_millis(F.try_to_timestamp(text, F.lit(fmt)))


def day_end_millis(text: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return day_start_millis(text, fmt) + (DAY_MILLIS - 1)


def approx_submit_time(submit: Column, history_mod_time: Column) -> Column:
    """Submit time, or an hour before the log was last written when the log holds none."""
    return F.when(submit == 0, history_mod_time - TYPICAL_JOB_MILLIS).otherwise(submit)
