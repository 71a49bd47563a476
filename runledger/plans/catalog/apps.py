"""Application queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ...functions.ids import APP_KEY
from ...operators import apps as O, flows
from ..views import Views
from .registry import TOTALS, WEEK, app_summary_sql, flows_sql, period_sql, query, queue_list, sums

WINDOW = (820454400000, 899251200000)
FIRST_SEEN = (790000000000, 800000000000)
_APP = ", ".join(APP_KEY)


@query("app_summary", "A3", app_summary_sql("flows"), "flows")
def app_summary(v: Views):
    return O.summarize(flows.roll_up(v.job_history()))


@query("daily_totals", "A4 A6 A7 A8 F24", "SELECT * FROM daily", "daily")
def daily_totals(v: Views):
    return O.period_totals(v.job_history(), "day")


@query("weekly_totals", "A5 A6 A7 A8 F24", period_sql(WEEK), "job_history")
def weekly_totals(v: Views):
    return O.period_totals(v.job_history(), "week")


def _merged_days(where: str) -> str:
    numbers = f"""SELECT {_APP}, {sums([*TOTALS, 'job_count', 'number_runs'])}, sum(cost) AS cost,
  min(period_start) AS first_day, max(period_start) AS last_day FROM daily WHERE {where} GROUP BY {_APP}"""
    names = f"""SELECT {_APP}, {queue_list('q')} AS queues FROM (
  SELECT {_APP}, unnest(string_split(rtrim(queues, '!'), '!')) AS q FROM daily WHERE {where}) GROUP BY {_APP}"""
    return f"SELECT * FROM ({numbers}) JOIN ({names}) USING ({_APP})"


_DAYS = "period_start BETWEEN 820454400000 AND 899251200000"


@query("all_apps", "A9", _merged_days(_DAYS), "daily")
def all_apps(v: Views):
    # both bounds lie inside a day; the whole days count
    return O.all_apps(O.period_totals(v.job_history(), "day"), None, WINDOW[0] + 5, WINDOW[1] + 7)


@query("all_apps_of_user_limited", "A9 N3", f"""
SELECT * FROM ({_merged_days(_DAYS + " AND user_name = 'BUILDING'")})
ORDER BY last_day DESC, user_name, app_id, cluster LIMIT 10""", "daily")
def all_apps_of_user_limited(v: Views):
    return O.all_apps(O.period_totals(v.job_history(), "day"), None, *WINDOW, user="BUILDING", limit=10)


_STATS = ["total_maps", "total_reduces", "mb_millis"]


@query("user_statistics", "A11 N7", f"""
SELECT user_name, {sums(_STATS)}, count(*) AS job_count FROM job_history
WHERE job_status = 'F' AND submit_time >= {WINDOW[0]} AND submit_time < {WINDOW[1]} GROUP BY user_name""", "job_history")
def user_statistics(v: Views):
    return O.statistics(v.job_history(), _STATS, status="F", start=WINDOW[0], end=WINDOW[1])


@query("app_statistics_top", "A11 W11 N4", f"""
SELECT user_name, app_id, {sums(_STATS)}, count(*) AS job_count FROM job_history WHERE framework = 'NONE'
GROUP BY user_name, app_id ORDER BY mb_millis DESC, user_name, app_id LIMIT 7""", "job_history")
def app_statistics_top(v: Views):
    return O.statistics(v.job_history(), _STATS, by_app=True, framework="NONE", sort="mb_millis", limit=7)


@query("app_versions", "A12", "SELECT * FROM versions", "versions")
def app_versions(v: Views):
    return v.app_version()


@query("latest_version", "W3", f"""
SELECT {_APP}, version, first_seen FROM versions
QUALIFY row_number() OVER (PARTITION BY {_APP} ORDER BY first_seen DESC, version DESC) = 1""", "versions")
def latest_version(v: Views):
    return O.latest_version(v.app_version())


@query("versions_newest_first", "W4", f"""
SELECT {_APP}, version, first_seen,
  CAST(row_number() OVER (ORDER BY first_seen DESC, version DESC) AS BIGINT) AS place
FROM versions WHERE cluster = 'AMERICA' AND user_name = 'BUILDING' AND app_id = '2-HIGH'""", "versions")
def versions_newest_first(v: Views):
    own = O.versions_of(v.app_version(), "AMERICA", "BUILDING", "2-HIGH")
    # one application has few versions, so the place in the list may be counted in one task
    return own.withColumn(
        "place", F.row_number().over(Window.orderBy(F.col("first_seen").desc(), F.col("version").desc())).cast("bigint")
    )


@query("new_apps", "P27", f"""
SELECT {_APP}, min(first_seen) AS first_seen FROM versions WHERE version = 'P' GROUP BY {_APP}
HAVING min(first_seen) BETWEEN {FIRST_SEEN[0]} AND {FIRST_SEEN[1]}""", "versions")
def new_apps(v: Views):
    # an application counts as new when it first left a partial job
    return O.new_apps(v.app_version().filter(F.col("version") == "P"), *FIRST_SEEN)


_WHOLE_JOBS = f"(SELECT * FROM job_history WHERE version <> 'P' AND run_id > {FIRST_SEEN[0]} AND run_id <= {FIRST_SEEN[1]})"


@query("new_app_summaries", "J3 N5", f"""
SELECT {_APP}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['number_runs', 'job_count', *TOTALS, 'first_run_id', 'last_run_id'])},
  coalesce(queues, '') AS queues
FROM (SELECT {_APP} FROM versions WHERE version = 'P' GROUP BY {_APP} HAVING min(first_seen) BETWEEN {FIRST_SEEN[0]} AND {FIRST_SEEN[1]})
LEFT JOIN ({app_summary_sql('(' + flows_sql(_WHOLE_JOBS) + ')')})
USING ({_APP})""", "versions job_history")
def new_app_summaries(v: Views):
    partial = v.app_version().filter(F.col("version") == "P")
    return O.new_app_summaries(partial, v.job_history().filter(F.col("version") != "P"), *FIRST_SEEN)


FIRST_YEAR = (788832000000, 820454399999)  # the last day of 1994 to the end of 1995


@query("new_apps_of_first_year", "P27", f"""
SELECT {_APP}, min(first_seen) AS first_seen FROM versions GROUP BY {_APP} HAVING min(first_seen) BETWEEN {FIRST_YEAR[0]} AND {FIRST_YEAR[1]}""", "versions")
def new_apps_of_first_year(v: Views):
    return O.new_apps(v.app_version(), *FIRST_YEAR)


@query("new_app_summaries_of_first_year", "J3 N5", f"""
SELECT {_APP}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ['number_runs', 'job_count', *TOTALS, 'first_run_id', 'last_run_id'])},
  coalesce(queues, '') AS queues
FROM (SELECT {_APP} FROM versions GROUP BY {_APP} HAVING min(first_seen) BETWEEN {FIRST_YEAR[0]} AND {FIRST_YEAR[1]})
LEFT JOIN ({app_summary_sql('(' + flows_sql(f"(SELECT * FROM job_history WHERE run_id > {FIRST_YEAR[0]} AND run_id <= {FIRST_YEAR[1]})") + ')')})
USING ({_APP})""", "versions job_history")
def new_app_summaries_of_first_year(v: Views):
    return O.new_app_summaries(v.app_version(), v.job_history(), *FIRST_YEAR)


@query("jobs_not_aggregated", "J10", """
SELECT cluster, job_id, run_id FROM job_history WHERE job_status <> 'F'""", "job_history")
def jobs_not_aggregated(v: Views):
    jobs = v.job_history().select("cluster", "job_id", "run_id", "job_status")
    done = v.job_history().filter(F.col("job_status") == "F").select("cluster", "job_id")
    return O.not_aggregated(jobs, done).drop("job_status")
