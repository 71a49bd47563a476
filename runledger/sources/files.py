"""Archive listings: one row per file with ``path``, ``mod_time`` (epoch millis), ``length``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths as P

MAX_FILE_BYTES = 524_288_000


def list_files(spark: SparkSession, root: str, with_content: bool = False, pattern: str | None = None) -> DataFrame:
    """Recursive listing. Without content only file metadata is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return as_listing(reader.load(root), with_content)


def as_listing(binary_files: DataFrame, with_content: bool = False) -> DataFrame:
    """Listing rows. ``source`` is where the content is, for files known under another ``path``."""
    cols = [
        F.col("path"),
        *([F.col("source")] if "source" in binary_files.columns else []),
        F.unix_millis("modificationTime").alias("mod_time"),
        F.col("length").cast("bigint").alias("length"),
    ]
    return binary_files.select(*cols, *(["content"] if with_content else []))


def modified_in(files: DataFrame, after: int, until: int) -> DataFrame:
    """Files with after < mod_time <= until."""
    return files.filter((F.col("mod_time") > after) & (F.col("mod_time") <= until))


def without_checksums(files: DataFrame) -> DataFrame:
    return files.filter(~P.is_checksum(F.col("path")))


def classify(files: DataFrame) -> DataFrame:
    """Adds ``file_name``, ``job_id`` and ``kind`` (conf, history, none)."""
    named = files.withColumn("file_name", P.base_name(F.col("path")))
    return named.withColumn("job_id", P.file_job_id(F.col("file_name"))).withColumn(
        "kind", P.file_kind(F.col("file_name"))
    )


def job_files(files: DataFrame) -> DataFrame:
    """Classified files that belong to a job."""
    return classify(files).filter(F.col("kind") != "none")


def prune_oversize(classified: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Drops files above the limit and the other files of the same job."""
    too_big = classified.filter(F.col("length") > max_bytes).select("job_id").distinct()
    fitting = classified.filter(F.col("length") <= max_bytes)
    return fitting.join(too_big, "job_id", "left_anti").select(*classified.columns)


def by_mod_time(files: DataFrame) -> DataFrame:
    return files.orderBy("mod_time", "path")


def with_archive_path(files: DataFrame, root: str = "") -> DataFrame:
    """Adds ``year``, ``month``, ``day`` and the ``target_path`` below the archive root."""
    year, month, day = P.archive_parts(F.col("mod_time"))
    dated = files.withColumns({"year": year, "month": month, "day": day})
    return dated.withColumn(
        "target_path",
        F.concat_ws("/", F.lit(root), "year", "month", "day", P.base_name(F.col("path"))),
    )


def not_archived(dated: DataFrame, archived: DataFrame) -> DataFrame:
    """Files whose target is not in the archive yet; ``archived`` holds ``target_path``."""
    return dated.join(archived.select("target_path").distinct(), "target_path", "left_anti").select(*dated.columns)


def archived(spark: SparkSession, root: str) -> DataFrame | None:
    """The target paths that lie in the archive; None while there is no archive."""
    try:
        return spark.read.parquet(root).select("target_path")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def archive(files: DataFrame, root: str) -> None:
    """Moves files (rows with path, mod_time and whatever else, content too) to the archive, below their UTC date.

    Folders are years; within one the rows are sorted by month and day, so a date finds its rows by the
    statistics of the files. (A folder for each day would cost every run a file for each day it touches.)
    A year of many rows goes to several files, years of few share a task.

    What already lies in the archive, by its listing, stays as it is, and a file given twice goes
    once; so the same files may be archived again after any interruption. An archive is added to by
    one writer at a time.
    """
    dated = with_archive_path(files, root)
    there = archived(files.sparkSession, root)
    new = dated if there is None else not_archived(dated, there)
    rows = new.dropDuplicates(["target_path"]).withColumns({c: F.col(c).cast("int") for c in ("month", "day")})
    by_date = rows.hint("rebalance", "year").sortWithinPartitions("year", "month", "day")
    by_date.write.mode("append").partitionBy("year").parquet(root)
