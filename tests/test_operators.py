"""Operators on small tables: golden cases, ties, and skewed data against brute force."""

import random

import re

import pytest
from pyspark.sql import functions as F

from runledger.functions import counters as K
from runledger.operators import apps, batches, events, flows, jobs as J, ordering, storage
from runledger.plans import reads
from runledger.sources import files, raw as R

DAY = 86_400_000
ZEROS = {c: 0 for c in flows.SUMS}


def job_frame(spark, rows):
    base = {
        "cluster": "c1", "user_name": "u", "app_id": "a", "run_id": 1, "job_epoch": 1, "job_seq": 1, "version": "v",
        "queue": "q", "history_version": "ONE", "submit_time": 1, "launch_time": 2, "finish_time": 3, "cost": 0.0,
        "job_status": "F", "framework": "NONE", **ZEROS,
    }
    full = [{**base, **r} for r in rows]
    kinds = {str: "string", int: "bigint", float: "double"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in base.items())
    frame = spark.createDataFrame([tuple(r[k] for k in base) for r in full], schema)
    return frame.withColumn("job_id", F.concat_ws("_", F.lit("job"), "job_epoch", "job_seq"))


def test_flow_of_three_jobs(spark):
    rows = [
        {"job_seq": 1, "submit_time": 100, "launch_time": 0, "finish_time": 500, "total_maps": 10, "total_reduces": 1, "queue": "first", "version": "x"},
        {"job_seq": 2, "submit_time": 100, "launch_time": 150, "finish_time": 900, "total_maps": 100, "total_reduces": 10, "queue": "second"},
        {"job_seq": 3, "submit_time": 200, "launch_time": 120, "finish_time": 700, "total_maps": 1000, "total_reduces": 10, "queue": "third", "version": "z"},
    ]
    flow = flows.roll_up(job_frame(spark, rows)).first()
    assert (flow.total_maps, flow.total_reduces, flow.job_count) == (1110, 21, 3)
    assert (flow.queue, flow.version) == ("first", "z")
    assert (flow.submit_time, flow.launch_time, flow.finish_time) == (100, 120, 900)
    assert (flow.duration, flow.wall_clock_time) == (780, 800)


def test_two_jobs_of_one_day(spark):
    rows = [
        {"job_seq": m, "run_id": 1402698420000 + m, "total_maps": 10 * m, "total_reduces": 10 * m, "map_slot_millis": 20 * m,
         "reduce_slot_millis": 222 * m, "mb_millis": 33 * m, "cost": 200.0 * m, "queue": f"queue_{m}"}
        for m in (1, 2)
    ]
    for period, start in (("day", 1402617600000), ("week", 1402185600000)):
        total = apps.period_totals(job_frame(spark, rows), period).first()
        assert (total.total_maps, total.total_reduces, total.map_slot_millis, total.reduce_slot_millis) == (30, 30, 60, 666)
        assert (total.mb_millis, total.cost, total.number_runs, total.job_count) == (99, 600.0, 2, 2)
        assert (total.queues, total.period_start) == ("queue_1!queue_2!", start)


def test_runs_are_counted_once_per_run(spark):
    rows = [{"job_seq": i, "run_id": 1 + i % 2} for i in range(6)]
    assert apps.period_totals(job_frame(spark, rows), "day").first().number_runs == 2


def test_jobs_without_run_are_flows_of_their_own(spark):
    rows = [{"job_seq": i, "run_id": 0 if i < 5 else 7} for i in range(1, 8)]
    jobs = job_frame(spark, rows)
    assert flows.roll_up(jobs).count() == 5
    picked = {(r.job_seq, r.flow_rank) for r in flows.newest_flows(jobs, 3).collect()}
    assert picked == {(5, 1), (6, 1), (7, 1), (1, 2), (2, 3)}


def test_newest_flows_with_one_hot_app(spark):
    """One application holds most jobs and one of its runs most of those."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        app = "hot" if i % 3 else f"a{rng.randrange(40)}"
        rows.append({"job_seq": i, "app_id": app, "run_id": 9 if i % 2 else rng.randrange(1, 30)})
    got = sorted((r.app_id, r.run_id, r.job_seq) for r in flows.newest_flows(job_frame(spark, rows), 4).collect())
    newest = {}
    for r in rows:
        newest.setdefault(r["app_id"], set()).add(r["run_id"])
    keep = {a: sorted(runs, reverse=True)[:4] for a, runs in newest.items()}
    assert got == sorted((r["app_id"], r["run_id"], r["job_seq"]) for r in rows if r["run_id"] in keep[r["app_id"]])


def test_run_window_and_version(spark):
    jobs = job_frame(spark, [{"job_seq": i, "run_id": i * 10, "version": v} for i, v in enumerate(["a", "b", "a", "b"], 1)])
    assert [r.run_id for r in flows.run_window(jobs, 10, 30).orderBy("run_id").collect()] == [20, 30]
    blank = jobs.withColumn("version", F.when(F.col("job_seq") != 1, F.col("version")))
    assert {r.job_seq for r in flows.of_version(blank, "b").collect()} == {1, 2, 4}


def test_pages_follow_each_other(spark):
    jobs = job_frame(spark, [{"job_seq": i, "run_id": i} for i in range(1, 8)])
    seen, start = [], None
    while True:
        page = flows.flow_stats_page(jobs, "c1", "u", "a", 3, start_key=start).collect()
        seen += [r.run_id for r in page if not r.is_next]
        following = [(r.run_id, r.solo_epoch, r.solo_seq) for r in page if r.is_next]
        if not following:
            break
        start = following[0]
    assert seen == [7, 6, 5, 4, 3, 2, 1]


def test_flows_without_run_id(spark):
    jobs = job_frame(spark, [{"job_seq": i, "run_id": 0} for i in range(1, 11)])
    seen, start = [], None
    while True:
        page = flows.flow_stats_page(jobs, "c1", "u", "a", 3, start_key=start).collect()
        seen += [r.solo_seq for r in page if not r.is_next]
        following = [(r.run_id, r.solo_epoch, r.solo_seq) for r in page if r.is_next]
        if not following:
            break
        start = following[0]
    assert seen == list(range(1, 11))
    assert [r.solo_seq for r in flows.flow_stats_page(jobs, "c1", "u", "a", 0).orderBy("page_row").collect()] == seen
    assert reads.flows_with_jobs(flows.roll_up(jobs), jobs).count() == 10
    assert [r.job_seq for r in flows.flow_of_job(jobs, "c1", "job_1_0004" if "job_1_0004" in {r.job_id for r in jobs.collect()} else "job_1_4").collect()] == [4]


def test_jobs_with_tasks_keeps_idle_jobs(spark):
    jobs = job_frame(spark, [{"job_seq": i} for i in range(4)])
    tasks = spark.createDataFrame([("c1", f"job_1_{0 if i else 2}", i) for i in range(50)], "cluster string, job_id string, task int")
    rows = flows.jobs_with_tasks(jobs, tasks).collect()
    assert len(rows) == 52
    assert {r.job_seq for r in rows if r.task is None} == {1, 3}


def test_positions_with_heavy_ties(spark):
    """A third of the rows share one sort value; positions stay exact and dense."""
    rng = random.Random(1)
    rows = [(5 if i % 3 == 0 else rng.randrange(1000), f"p{i:05d}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "mod_time bigint, path string")
    got = {r.path: r.position for r in ordering.with_position(frame, [F.col("mod_time"), F.col("path")]).collect()}
    assert got == {path: i for i, (_, path) in enumerate(sorted(rows), 1)}


@pytest.mark.parametrize("n,size,ranges", [(3, 1, [(1, 1), (2, 2), (3, 3)]), (10, 3, [(1, 3), (4, 6), (7, 9), (10, 10)]), (10, 17, [(1, 10)])])
def test_id_ranges(spark, n, size, ranges):
    jobs = spark.range(1, n + 1).select(F.lit(5).cast("bigint").alias("job_epoch"), F.col("id").alias("job_seq"))
    got = batches.id_ranges(jobs, size).orderBy("batch").collect()
    assert [(r.min_job_id, r.max_job_id) for r in got] == [(f"job_5_{a:04d}", f"job_5_{b:04d}") for a, b in ranges]


def test_batch_counts_and_retention(spark, value):
    for length, size, expected in [(10, 3, 4), (9, 3, 3), (0, 3, 0), (5, 0, 0), (1, 9, 1)]:
        assert value(batches.batch_count(F.lit(length), size)) == expected
    listing = spark.createDataFrame([(f"f{i}", i) for i in range(5)], "path string, mod_time bigint")
    assert {r.path for r in batches.retained(listing, 2).collect() if r.retain} == {"f3", "f4"}
    assert all(r.retain for r in batches.retained(listing, 9).collect())


def test_oversize_files_take_their_sibling(spark):
    rows = [("x/job_1_1_conf.xml", 5), ("x/job_1_1_hist", 50), ("x/job_1_2_conf.xml", 5), ("x/job_1_2_hist", 6), ("x/other", 1)]
    listing = spark.createDataFrame(rows, "path string, length bigint").withColumn("mod_time", F.lit(1).cast("bigint"))
    kept = files.prune_oversize(files.job_files(listing), 10).collect()
    assert {r.path for r in kept} == {"x/job_1_2_conf.xml", "x/job_1_2_hist"}


def test_raw_rows_to_process(spark):
    rows = [("job_1_1", True, None), ("job_1_2", False, None), ("job_1_10", None, True), ("job_1_3", None, None)]
    raw = spark.createDataFrame(rows, "job_id string, processed_ok boolean, reprocess boolean").select(
        F.lit("c").alias("cluster"), "*", F.split("job_id", "_")[1].cast("bigint").alias("job_epoch"),
        F.split("job_id", "_")[2].cast("bigint").alias("job_seq"), F.lit(b"x").alias("conf"),
        F.when(F.col("job_id") != "job_1_3", F.lit(b"y")).alias("history"), F.lit(None).cast("bigint").alias("submit_time"),
    )
    assert {r.job_id for r in R.to_process(raw).collect()} == {"job_1_2", "job_1_10"}
    # ids compare as numbers
    assert {r.job_id for r in R.to_process(raw, max_job_id="job_1_9").collect()} == {"job_1_2"}
    assert {r.job_id for r in R.to_process(raw, reprocess=True).collect()} == {"job_1_10"}


def test_storage_series_and_snapshot(spark):
    start = 1391896800
    rows = [(f"c1", f"/p{p}", ns, start + 7200 * i, 10 + i, f"o{ns}") for p in (1, 2) for ns in ("n1", "n2") for i in range(5)]
    usage = spark.createDataFrame(rows, "cluster string, path string, namespace string, run_id bigint, file_count bigint, owner string")
    for c in storage.COUNTS[1:]:
        usage = usage.withColumn(c, F.lit(None).cast("bigint"))
    for c in storage.COSTS:
        usage = usage.withColumn(c, F.lit(1.5))
    newest = start + 7200 * 4
    series = storage.series(usage, "c1", "/P1", newest, newest - 7200 * 3 - 1).collect()
    assert sorted(r.run_id for r in series) == [start + 7200 * i for i in range(1, 5)]
    assert {r.owner for r in series} == {"on2"} and {r.hdfs_cost for r in series} == {6.0}
    assert {r.file_count for r in storage.snapshot(usage, "c1", start + 100).collect()} == {20}
    assert storage.snapshot(usage, "c1", start + 3700).count() == 0
    assert {r.run_id for r in storage.snapshot_as_of(usage, "c1", start + 3700).collect()} == {start}
    assert storage.snapshot_as_of(usage, "c1", start - 1).count() == 0
    with pytest.raises(ValueError):
        storage.series(usage, "c1", "/p1", 1, 2)


def test_app_versions(spark):
    jobs = job_frame(spark, [{"job_seq": i, "version": v, "run_id": r} for i, (v, r) in enumerate([("b", 5), ("a", 9), ("b", 2), ("c", 9)])])
    versions = apps.versions(jobs)
    assert [(r.version, r.first_seen) for r in apps.versions_of(versions, "c1", "u", "a").collect()] == [("c", 9), ("a", 9), ("b", 2)]
    assert apps.latest_version(versions).first().version == "c"
    assert apps.new_apps(versions, 2, 2).count() == 1 and apps.new_apps(versions, 3, 9).count() == 0


def test_new_apps_without_flows_stay(spark):
    jobs = job_frame(spark, [{"job_seq": 1, "run_id": 5}])
    row = apps.new_app_summaries(apps.versions(jobs), jobs, 5, 9).first()  # a run at the start is outside the window
    assert (row.number_runs, row.queues) == (0, "")


def test_statistics_limits(spark):
    jobs = job_frame(spark, [{"job_seq": i, "user_name": f"u{i % 4}", "total_maps": i} for i in range(12)])
    assert apps.statistics(jobs, ["total_maps"]).count() == 4
    top = apps.statistics(jobs, ["total_maps"], sort="total_maps", limit=2).collect()
    assert [(r.user_name, r.total_maps) for r in top] == [("u3", 21), ("u2", 18)]
    assert apps.statistics(jobs.withColumn("job_status", F.lit(None).cast("string")), ["total_maps"], status="F").count() == 0


def test_status_moves_and_pages(spark):
    rows = [("c1", i, 1000 * i, "u" if i % 2 else None, "RUNNING", i) for i in range(1, 5)]
    statuses = spark.createDataFrame(rows, "cluster string, flow_id bigint, ts bigint, user_name string, status string, update_seq bigint")
    page = events.status_page(statuses, "c1", "RUNNING", 1).collect()
    assert [(r.flow_id, r.is_next) for r in page] == [(4, False), (3, True)]
    assert [r.flow_id for r in events.with_status(statuses, "c1", "RUNNING", "u").collect()] == [3, 1]
    moves = spark.createDataFrame([("c1", 4, 4000, "RUNNING", "SUCCEEDED"), ("c1", 9, 1, "RUNNING", "FAILED")],
                                  "cluster string, flow_id bigint, ts bigint, old_status string, new_status string")
    moved = {r.flow_id: r for r in events.move_status(statuses, moves).collect()}
    assert moved[4].status == "SUCCEEDED" and moved[3].status == "RUNNING" and moved[9].error == "no row for flow 9"


def test_removal_counts_rows(spark):
    jobs = job_frame(spark, [{"job_seq": i} for i in range(3)])
    tasks = spark.createDataFrame([("c1", "job_1_1", i) for i in range(4)], "cluster string, job_id string, task int")
    kept_jobs, kept_tasks, gone = J.removal(jobs, tasks, jobs.filter("job_seq = 1"))
    assert (kept_jobs.count(), kept_tasks.count()) == (2, 0)
    assert [(r.job_id, r.rows_removed) for r in gone.collect()] == [("job_1_1", 5)]


def test_counter_sums(spark):
    text = {1: "{(group1)(x)[(key1)(x)(100)]}{(group2)(x)[(key1)(x)(1000)]}", 2: "{(group1)(x)[(key1)(x)(50)]}{(group2)(x)[(key1)(x)(100)]}"}
    jobs = job_frame(spark, [{"job_seq": i} for i in text])
    cells = K.from_text(F.when(F.col("job_seq") == 1, F.lit(text[1])).otherwise(F.lit(text[2])))
    none = F.create_map().cast(K.NESTED)
    jobs = jobs.withColumns({"counters": K.nested(cells), "map_counters": none, "reduce_counters": none})
    got = {(r.kind, r.counter_group, r.counter_name): r.value for r in flows.counter_sums(jobs).collect()}
    assert got == {("total", "group1", "key1"): 150, ("total", "group2", "key1"): 1100}


def test_read_defaults(spark):
    jobs = job_frame(spark, [{"job_seq": i, "run_id": i * DAY} for i in range(1, 61)])
    assert reads.flow_series(jobs, "c1", "u", "a", limit=0).count() == 1
    assert reads.flow_series(jobs, "c1", "u", "a", limit=99, now=60 * DAY).count() == 30
    daily = apps.period_totals(jobs, "day")
    assert reads.all_apps(daily, "c1", 60 * DAY).first().job_count == 2  # both days count whole
    with pytest.raises(ValueError):
        reads.cluster_of(jobs, " ")


def test_usage_by_day_is_read_in_the_days_needed(spark, tmp_path):
    from runledger.operators import storage

    hour = 3600
    counts = {c: 1 for c in [*storage.COUNTS]}
    rows = [("c1", "/a/b", "n", d * 86_400 + h * hour, "o", *counts.values(), 0.5, 0.25) for d in range(10, 30) for h in (0, 5, 23)]
    schema = "cluster string, path string, namespace string, run_id bigint, owner string, " + ", ".join(f"{c} bigint" for c in counts) + ", access_cost double, storage_cost double"
    usage = spark.createDataFrame(rows, schema)
    storage.write_usage(usage, str(tmp_path / "usage"))
    stored = spark.read.parquet(str(tmp_path / "usage"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    for read in (lambda u: storage.snapshot(u, "c1", 12 * 86_400 + 5 * hour + 7), lambda u: storage.snapshot_as_of(u, "c1", 12 * 86_400 + 6 * hour, horizon_days=3),
                 lambda u: storage.series(u, "c1", "/A/B", 14 * 86_400, 12 * 86_400 + hour)):
        got = read(stored)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, read(usage).collect())) and got.count()
        filters = re.search(r"PartitionFilters: \[([^\]]*)", got.select("*")._jdf.queryExecution().executedPlan().toString())[1]
        assert "day#" in filters and ">=" in filters and "<=" in filters
    spark.conf.unset("spark.sql.maxMetadataStringLength")
