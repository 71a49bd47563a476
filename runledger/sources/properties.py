"""Property files as tables: one ``key=value`` a line, ``#`` and ``!`` begin comments.

Key and value are separated by ``=``, ``:`` or blanks; a backslash takes the next character as it is.
Values do not go on over line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LINE = r"^\s*((?:\\.|[^\\=:\s])+)\s*[=:]?\s*(.*?)\s*$"
# What follows the machine type in the keys of a rate file.
COST_KEY, MEMORY_KEY = ".computecost", ".machinememory"


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """key, value; of a key that occurs twice, both rows."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([#!]|$)"))
    return lines.select(_plain(F.regexp_extract("value", LINE, 1)).alias("key"), _plain(F.regexp_extract("value", LINE, 2)).alias("value"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """host, cluster: the table that :func:`runledger.operators.jobs.cluster_of_host` takes."""
    return read_properties(spark, path).select(F.col("key").alias("host"), F.col("value").alias("cluster"))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """machine_type, compute_cost, machine_memory, as :func:`runledger.operators.jobs.with_cost` takes them; missing and
    malformed numbers are 0."""
    rows = read_properties(spark, path)
    kind = F.substring_index("key", ".", -1)
    of_type = rows.withColumn("machine_type", F.substr("key", F.lit(1), F.length("key") - F.length(kind) - 1))

    def pick(ending: str, to: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("key").endswith(ending), F.trim("value").try_cast(to))), F.lit(0).cast(to))

    return of_type.where(F.col("key").endswith(COST_KEY) | F.col("key").endswith(MEMORY_KEY)).groupBy("machine_type").agg(
        pick(COST_KEY, "double").alias("compute_cost"), pick(MEMORY_KEY, "bigint").alias("machine_memory"))
