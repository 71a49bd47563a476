"""File listing, raw row and ingest batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import defaults as D, ids, times as T
from ...operators import batches as B, jobs as J
from ...operators.ordering import with_position
from ...session import new_work_path
from ...sources import files as S, raw as R
from ..views import Views
from .registry import query

SIZE = 100


def _classified(v: Views):
    return S.job_files(v.files())


def write_parts(docs, path: str, mode: str = "errorifexists") -> None:
    """Documents as one text file per ``doc_id % 64``, each in a folder of its own."""
    parts = docs.select((F.col("doc_id") % 64).alias("part"), F.col("text").alias("value"))
    parts.repartition("part").write.mode(mode).partitionBy("part").text(path)


def part_of(path: str = "path"):
    return F.regexp_extract(path, "/part=([0-9]+)/", 1).cast("bigint")


FILES_SQL = "SELECT CAST(doc_id % 64 AS BIGINT) AS part, CAST(sum(strlen(text) + 1) AS BIGINT) AS length FROM documents GROUP BY 1"


@query("table_files", "S1", FILES_SQL)
def table_files(v: Views):
    """A tree of files written from the documents, listed recursively."""
    path = new_work_path(v.spark, "tree")
    write_parts(v.table("documents"), path)
    return S.list_files(v.spark, path, pattern="part-*").select(part_of().alias("part"), "length")


@query("files_in_range", "S2", "SELECT * FROM files WHERE mod_time > 120 AND mod_time <= 870", "files")
def files_in_range(v: Views):
    return S.modified_in(v.files(), 120, 870)


@query("files_without_checksums", "S3", "SELECT * FROM files WHERE length % 4 <> 0", "files")
def files_without_checksums(v: Views):
    named = v.files().withColumn(
        "path", F.when(F.col("length") % 4 == 0, F.concat("path", F.lit(".crc"))).otherwise(F.col("path"))
    )
    return S.without_checksums(named)


@query("file_kinds", "S4", """
SELECT path || e AS path, regexp_extract(path, '[^/]*$') || e AS file_name,
  CASE WHEN e IN ('', '.xml') THEN regexp_extract(path, '(job_[0-9]+_[0-9]+)', 1) END AS job_id,
  CASE WHEN e = '.crc' OR e = '.crc.crc' THEN 'none' WHEN e = '' AND path LIKE '%conf.xml' THEN 'conf' ELSE 'history' END AS kind
FROM files, (VALUES (''), ('.crc'), ('.xml')) s(e)""", "files")
def file_kinds(v: Views):
    ends = F.explode(F.array(F.lit(""), F.lit(".crc"), F.lit(".xml"))).alias("e")
    named = v.files().select("path", ends).select(F.concat("path", "e").alias("path"))
    return S.classify(named)


@query("pruned_files", "J7", """
SELECT * FROM job_files WHERE length <= 9000 AND job_id NOT IN (SELECT job_id FROM job_files WHERE length > 9000)""", "job_files")
def pruned_files(v: Views):
    return S.prune_oversize(_classified(v), 9000)


@query("paired_files", "J4", """
SELECT 'all' AS cluster, c.job_id, c.path AS conf_path, c.mod_time AS conf_mod_time, h.path AS history_path, h.mod_time AS history_mod_time
FROM job_files c JOIN job_files h ON c.job_id = h.job_id
WHERE c.kind = 'conf' AND h.kind = 'history'""", "job_files")
def paired_files(v: Views):
    # conf and history of a job lie in different source folders here; take all as one cluster
    files = _classified(v).withColumn("cluster", F.lit("all"))
    return R.pair_files(files)


@query("archive_targets", "S12", """
SELECT path, mod_time, strftime(make_timestamp(mod_time * 86400000 * 1000), '%Y') AS year,
  strftime(make_timestamp(mod_time * 86400000 * 1000), '%m') AS month, strftime(make_timestamp(mod_time * 86400000 * 1000), '%d') AS day,
  '/done/' || strftime(make_timestamp(mod_time * 86400000 * 1000), '%Y/%m/%d') || '/' || string_split(path, '/')[2] AS target_path
FROM files""", "files")
def archive_targets(v: Views):
    # document ids stand for modification times; one step is stretched to one day
    daily = v.files().withColumn("step", F.col("mod_time")).withColumn("mod_time", F.col("mod_time") * T.DAY_MILLIS)
    return S.with_archive_path(daily, "/done").select(
        "path", F.col("step").alias("mod_time"), "year", "month", "day", "target_path"
    )


@query("files_archived_once", "S12 J9", """
SELECT path, length, CAST(strftime(make_timestamp(mod_time * 86400000 * 1000), '%Y') AS INTEGER) AS year, CAST(strftime(make_timestamp(mod_time * 86400000 * 1000), '%m') AS INTEGER) AS month,
  CAST(strftime(make_timestamp(mod_time * 86400000 * 1000), '%d') AS INTEGER) AS day FROM files""", "files")
def files_archived_once(v: Views):
    """Some files archived, then all, then all again: each lies in the archive once, below its date."""
    root = new_work_path(v.spark, "archive")
    # document ids stand for modification times, one step a day
    files = v.files().withColumn("mod_time", F.col("mod_time") * T.DAY_MILLIS)
    for part in (files.where("length % 3 = 0"), files, files):
        S.archive(part, root)
    return v.spark.read.parquet(root).select("path", "length", "year", "month", "day")


@query("files_not_archived", "J9", "SELECT path, length FROM files WHERE length % 3 <> 0", "files")
def files_not_archived(v: Views):
    dated = S.with_archive_path(v.files(), "/done")
    return S.not_archived(dated, dated.filter(F.col("length") % 3 == 0)).select("path", "length")


@query("files_in_order", "W8", "SELECT *, CAST(row_number() OVER (ORDER BY mod_time, path) AS BIGINT) AS position FROM files", "files")
def files_in_order(v: Views):
    return with_position(v.files(), [F.col("mod_time"), F.col("path")])


@query("files_retained", "W9", "SELECT *, row_number() OVER (ORDER BY mod_time DESC, path DESC) <= 150 AS retain FROM files", "files")
def files_retained(v: Views):
    return B.retained(v.files(), 150)


_SPAN = """min(mod_time) AS min_mod_time, max(mod_time) AS max_mod_time, count(*) AS processed_job_files,
  printf('job_1_%04d', min(CAST(string_split(job_id, '_')[3] AS BIGINT))) AS min_job_id,
  printf('job_1_%04d', max(CAST(string_split(job_id, '_')[3] AS BIGINT))) AS max_job_id"""
_BATCHES = f"""(SELECT CAST((p - 1) // {SIZE} AS BIGINT) AS batch, {_SPAN}, 1 AS processing_state
FROM (SELECT *, row_number() OVER (ORDER BY mod_time, path) AS p FROM job_files) GROUP BY ALL)"""


@query("file_span", "A13", f"SELECT {_SPAN} FROM job_files", "job_files")
def file_span(v: Views):
    return B.span(_classified(v))


@query("file_batches", "A16", f"SELECT * FROM {_BATCHES}", "job_files")
def file_batches(v: Views):
    return B.file_batches(_classified(v), SIZE)


@query("job_id_ranges", "W6", f"""
SELECT CAST((p - 1) // {SIZE} AS BIGINT) AS batch, printf('job_1_%04d', min(o_orderkey)) AS min_job_id,
  printf('job_1_%04d', max(o_orderkey)) AS max_job_id, count(*) AS ids
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) GROUP BY ALL""")
def job_id_ranges(v: Views):
    jobs = v.table("orders").select(F.lit(1).cast("bigint").alias("job_epoch"), F.col("o_orderkey").alias("job_seq"))
    return B.id_ranges(jobs, SIZE)


@query("batch_counts", "W7", """
SELECT cluster, count(*) AS files, CAST(CASE WHEN count(*) % 7 = 0 THEN count(*) // 7 ELSE count(*) // 7 + 1 END AS BIGINT) AS batches,
  CAST(0 AS BIGINT) AS no_batches FROM files GROUP BY cluster""", "files")
def batch_counts(v: Views):
    counted = v.files().groupBy("cluster").agg(F.count("*").alias("files"))
    return counted.withColumns({"batches": B.batch_count(F.col("files"), 7), "no_batches": B.batch_count(F.col("files"), 0)})


_INGEST = f"""(SELECT *, min_job_id || '/' || batch || '.seq' AS process_file, CAST(batch % 4 AS INTEGER) AS state,
  'k' || (batch % 2) AS cluster FROM {_BATCHES})"""


def _ingest(v: Views):
    """Ingest batches in every state, on two clusters."""
    batches = B.file_batches(_classified(v), SIZE)
    return batches.withColumns(
        {
            "processing_state": (F.col("batch") % 4).cast("int"),
            "process_file": F.concat_ws("/", "min_job_id", F.concat(F.col("batch").cast("string"), F.lit(".seq"))),
            "cluster": F.concat(F.lit("k"), (F.col("batch") % 2).cast("string")),
        }
    )


_ROW = "batch, cluster, max_mod_time, processed_job_files, process_file, state AS processing_state"
_COLS = ["batch", "cluster", "max_mod_time", "processed_job_files", "process_file", "processing_state"]


@query("ingest_batches_found", "P24", f"""
SELECT {_ROW} FROM {_INGEST} WHERE state >= 1 AND process_file LIKE '%0%' ORDER BY max_mod_time DESC, batch DESC LIMIT 4""", "job_files")
def ingest_batches_found(v: Views):
    return B.find_batches(_ingest(v), "GREATER_OR_EQUAL", 1, "0", 4).select(*_COLS)


@query("ingest_last_successful", "W12", f"""
SELECT {_ROW} FROM {_INGEST} WHERE state <> 0 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY max_mod_time DESC, batch DESC) = 1""", "job_files")
def ingest_last_successful(v: Views):
    return B.last_successful(_ingest(v)).select(*_COLS)


@query("ingest_summary", "A15", f"SELECT count(*) AS batches, CAST(sum(processed_job_files) AS BIGINT) AS files FROM {_BATCHES}", "job_files")
def ingest_summary(v: Views):
    return B.ingest_summary(B.file_batches(_classified(v), SIZE))


@query("ingest_states", "F35", f"""
SELECT batch, CASE state WHEN 1 THEN 'PREPROCESSED' WHEN 2 THEN 'LOADED' WHEN 3 THEN 'PROCESSED' ELSE 'CREATED' END AS state_name
FROM {_INGEST}""", "job_files")
def ingest_states(v: Views):
    return _ingest(v).select("batch", D.ingest_state(F.col("processing_state")).alias("state_name"))


# --- raw rows ---------------------------------------------------------------------------------

_FLAGS = "job_id, job_seq, processed_ok, reprocess"


@query("raw_loaded", "S5", """
SELECT 'c1' AS cluster, printf('job_1_%04d', doc_id // 2) AS job_id, CAST(1 AS BIGINT) AS job_epoch, doc_id // 2 AS job_seq,
  max(CASE WHEN doc_id % 2 = 0 THEN md5(text) END) AS conf_md5, max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS conf_mod_time,
  max(CASE WHEN doc_id % 2 = 1 THEN md5(text) END) AS history_md5, max(CASE WHEN doc_id % 2 = 1 THEN doc_id END) AS history_mod_time
FROM documents GROUP BY doc_id // 2""")
def raw_loaded(v: Views):
    docs = v.table("documents")
    half = F.call_function("div", F.col("doc_id"), F.lit(2))
    kind = F.when(F.col("doc_id") % 2 == 0, F.lit("_conf.xml")).otherwise(F.lit("_hist"))
    files = docs.select(
        F.concat(F.col("source"), F.lit("/"), ids.job_id_string(F.lit(1), half), kind).alias("path"),
        F.col("doc_id").alias("mod_time"), F.col("n_chars").alias("length"), F.col("text").cast("binary").alias("content"),
    )
    loaded = R.load_raw(S.job_files(files), "c1")
    return loaded.select(
        "cluster", "job_id", "job_epoch", "job_seq", F.md5("conf").alias("conf_md5"), "conf_mod_time",
        F.md5("history").alias("history_md5"), "history_mod_time",
    )


@query("raw_forced", "S6", "SELECT job_id, false AS processed_ok, reprocess FROM raw_jobs", "raw_jobs")
def raw_forced(v: Views):
    return R.force_reprocess(v.raw_jobs()).select("job_id", "processed_ok", "reprocess")


@query("raw_to_process", "S7", f"""
SELECT {_FLAGS} FROM raw_jobs WHERE processed_ok IS DISTINCT FROM true AND conf IS NOT NULL AND history IS NOT NULL
AND job_seq BETWEEN 20 AND 400""", "raw_jobs")
def raw_to_process(v: Views):
    return R.to_process(v.raw_jobs(), "c1", "job_1_0020", "job_1_0400").select("job_id", "job_seq", "processed_ok", "reprocess")


@query("raw_to_reprocess", "S7", f"""
SELECT {_FLAGS} FROM raw_jobs WHERE reprocess AND conf IS NOT NULL AND history IS NOT NULL""", "raw_jobs")
def raw_to_reprocess(v: Views):
    return R.to_process(v.raw_jobs(), reprocess=True).select("job_id", "job_seq", "processed_ok", "reprocess")


@query("raw_blob_text", "S16", "SELECT cluster, job_id, history AS text FROM raw_jobs WHERE job_id = 'job_1_0031'", "raw_jobs")
def raw_blob_text(v: Views):
    return R.blob_text(v.raw_jobs(), "job_1_0031", "history")


@query("raw_status_applied", "S18", """
SELECT job_id, CASE WHEN job_seq % 4 = 0 THEN true WHEN job_seq % 4 = 1 THEN false ELSE processed_ok END AS processed_ok,
  CASE WHEN job_seq % 4 = 0 THEN false WHEN job_seq % 4 = 2 THEN true ELSE reprocess END AS reprocess,
  CASE WHEN job_seq % 4 <> 3 THEN job_seq * 10 END AS submit_time FROM raw_jobs""", "raw_jobs")
def raw_status_applied(v: Views):
    raw = v.raw_jobs()
    turn = F.col("job_seq") % 4
    updates = raw.filter(turn != 3).select(
        "cluster", "job_id",
        F.when(turn == 0, F.lit(True)).when(turn == 1, F.lit(False)).alias("processed_ok"),
        F.when(turn == 2, F.lit(True)).alias("reprocess"),
        (F.col("job_seq") * 10).alias("submit_time"),
    )
    return R.apply_status(raw, updates).select("job_id", "processed_ok", "reprocess", "submit_time")


@query("raw_partial", "P19", """
SELECT job_id FROM raw_jobs WHERE conf_mod_time % 3 = 0 OR conf IS NULL OR conf = '' OR history IS NULL OR history = ''""", "raw_jobs")
def raw_partial(v: Views):
    raw = v.raw_jobs()
    third = F.col("conf_mod_time") % 3 == 0
    return J.partial_raw(raw.withColumn("conf", F.when(~third, F.col("conf")))).select("job_id")


@query("parse_outcomes", "A14", """
SELECT count(*) FILTER (processed_ok) AS success_rows, count(*) FILTER (NOT processed_ok) AS error_rows FROM raw_jobs""", "raw_jobs")
def parse_outcomes(v: Views):
    return B.outcome_counts(v.raw_jobs())


@query("approx_submit_times", "F17", """
SELECT job_id, CASE WHEN conf_mod_time % 4 = 0 THEN history_mod_time - 3600000 ELSE conf_mod_time % 4 END AS submit_time FROM raw_jobs""", "raw_jobs")
def approx_submit_times(v: Views):
    raw = v.raw_jobs()
    return raw.select("job_id", T.approx_submit_time(F.col("conf_mod_time") % 4, F.col("history_mod_time")).alias("submit_time"))
