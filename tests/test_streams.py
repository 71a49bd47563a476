"""Streams over several micro-batches."""

import os

from pyspark.sql import functions as F
from test_logs import CONF, JSON, TEXT

from runledger.plans import ingest
from runledger.sources import raw as R
from runledger.streaming import events as E, ingest as I, sinks, totals as T

DAY = 86_400_000
JOB = ("cluster string, user_name string, app_id string, run_id bigint, cost double, "
       "total_maps bigint, total_reduces bigint, mb_millis bigint, map_slot_millis bigint, reduce_slot_millis bigint")


def stream_of(spark, frames, schema, folder):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    return reader.parquet(folder)


def test_late_jobs_count(spark, tmp_path):
    def job(day):
        return ("c", "u", "a", day * DAY + 5, 1.0, 1, 1, 1, 1, 1)

    frames = [[job(400), job(400)], [job(401)], [job(100), job(402)], [job(100)]]
    jobs = stream_of(spark, frames, JOB, str(tmp_path / "jobs"))
    daily = sinks.drain_updates(T.running_totals(jobs, "day"), "late-daily", T.KEYS).collect()
    assert {r.period_start // DAY: r.job_count for r in daily} == {400: 2, 401: 1, 402: 1, 100: 2}
    runs = T.run_counts(sinks.drain_append(T.new_runs(jobs), "late-runs")).collect()
    assert {r.period_start // DAY: r.number_runs for r in runs} == {400: 1, 401: 1, 402: 1, 100: 1}


def test_marks_of_runs_leave_after_30_days(spark, tmp_path):
    """Runs stay exact although the state forgets them: the written rows are the marks of older runs."""
    def job(run, arrived):
        return ("c", "u", "a", run * DAY + 5, 1.0, 1, 1, 1, 1, 1, arrived)

    frames = [[job(400, 0), job(401, 0)], [job(400, 20), job(402, 20)], [job(403, 60)], [job(400, 61), job(402, 61)], [job(404, 120)], [job(400, 121)]]
    jobs = stream_of(spark, frames, JOB + ", arrived int", str(tmp_path / "jobs"))
    at = F.timestamp_seconds((F.col("arrived") + 1000) * 86_400)
    query = sinks.start_append(T.new_runs(jobs, arrived=at), str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "table"))
    assert {r.period_start // DAY: r.number_runs for r in T.run_counts(rows).collect()} == {d: 1 for d in (400, 401, 402, 403, 404)}
    assert rows.count() > 5  # runs 400 and 402 came again after their marks had gone
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 4 and kept[-1] <= 3  # of seven marks made; marks leave a micro-batch after their time


def test_the_last_write_of_an_event_wins(spark, tmp_path):
    frames = [[("c", 1, 1, "old", 1), ("c", 1, 2, "x", 2)], [("c", 1, 1, "new", 3), ("c", 1, 1, "newest", 4)]]
    events = stream_of(spark, frames, "cluster string, flow_id int, sequence int, data string, write_seq int", str(tmp_path / "events"))
    E.start_events(events, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    got = E.stored_events(spark, str(tmp_path / "table")).select("sequence", "data").collect()
    assert sorted(map(tuple, got)) == [(1, "newest"), (2, "x")]


def test_pairs_complete_over_micro_batches(spark, tmp_path):
    """One file per micro-batch: every pair is processed once, in the batch that completes it, and jobs with a file
    too large become rows with the reason."""
    files = {"job_7_0001_hist": TEXT, "job_7_0002_conf.xml": CONF, "job_7_0004_conf.xml": "x" * 50_000,
             "job_7_0002_hist": JSON, "job_7_0001_conf.xml": CONF, "job_7_0004_hist": JSON, "job_7_0005_hist": JSON}
    folder = tmp_path / "in"
    folder.mkdir()
    for k, (name, text) in enumerate(files.items()):
        (folder / name).write_text(text)
        os.utime(folder / name, (1e9 + 100 * k, 1e9 + 100 * k))
    book = ingest.Ledger(spark, str(tmp_path / "tables"), by="year")
    calls = []

    def process(pairs, batch_id):
        calls.append((batch_id, [r.job_id for r in pairs.collect()]))
        described, records = ingest.parsed_files(spark, pairs, "c1", str(tmp_path / "stage" / str(batch_id)))
        ingest.store(book, described, records, batch=batch_id)
        for kind in ("conf", "history"):  # content is scanned, never exchanged
            plan = R.contents(spark, pairs, kind)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Sort" not in plan

    I.start_ingest(I.file_stream(spark, str(folder), files_per_batch=1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), "c1", process, max_bytes=20_000).awaitTermination()
    assert calls == [(3, ["job_7_0002"]), (4, ["job_7_0001"])]
    rejects = spark.read.parquet(str(tmp_path / "out" / "rejected")).where("batch = 5").collect()
    assert {(r.path.split("/")[-1], r.reason) for r in rejects} == {
        ("job_7_0004_conf.xml", "too large"), ("job_7_0004_hist", "the other file of its job is too large")}
    waiting = spark.read.parquet(str(tmp_path / "out" / "waiting")).where("batch = 6").collect()
    assert {r.job_id for r in waiting} == {"job_7_0004", "job_7_0005"}
    states = I.current_states(spark.read.parquet(str(tmp_path / "out" / "ingest_batch"))).collect()
    assert len(states) == 7 and {r.state_name for r in states} == {"PROCESSED"}

    # the same rows as from whole raw rows
    pairs = spark.read.schema(R.JOB_FILES).parquet(str(tmp_path / "out" / "jobs")).where("conf IS NOT NULL AND history IS NOT NULL")
    times = {r.job_id: r.history.mod_time for r in pairs.collect()}
    raw = spark.createDataFrame([("c1", j, CONF.encode(), log.encode(), times[j]) for j, log in (("job_7_0001", TEXT), ("job_7_0002", JSON))],
                                "cluster string, job_id string, conf binary, history binary, history_mod_time bigint")
    described, records = ingest.staged(raw)
    stored = ingest.stored_tables(spark, book.root)
    for name, want in (("job_history", ingest.job_rows(described, records)), ("job_history_task", ingest.task_rows(records))):
        columns = sorted(want.columns)
        assert sorted(map(repr, stored[name].select(columns).collect())) == sorted(map(repr, want.select(columns).collect()))
