"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into the no-op sink: every row is produced, none is kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

from runledger.plans.catalog import QUERIES
from runledger.session import build_session

HEADLINE = [
    "newest_flow_summaries", "flow_roll_up", "newest_flow_jobs", "flow_counter_sums", "flow_of_job", "jobs_with_tasks",
    "flow_stats_page", "app_summary", "daily_totals", "weekly_totals", "all_apps", "new_app_summaries",
    "app_statistics_top", "latest_version", "job_details", "job_costs", "storage_merged", "storage_as_of",
    "storage_series", "flow_status", "pruned_files", "file_batches", "job_id_ranges", "counters_from_text",
    "text_log_records", "json_log_events", "merged_records", "ingested_jobs", "stream_daily_totals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "runledger-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took = round(time.perf_counter() - start, 3)
        print(f"{name} {took}", file=sys.stderr, flush=True)
        return took

    run(names[0])  # starts the JVM's compilers and the file cache
    seconds = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
