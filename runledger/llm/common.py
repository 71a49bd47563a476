"""What the operators share: input rows, words, hashes, written intermediate tables."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_work_path

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pinned(df: DataFrame, label: str, free: bool = False, per_file: int = 0) -> DataFrame:
    """Writes the rows below the shared folder and reads them back: computed once, no lineage.

    ``free``: what was shuffled for them is deleted as soon as they are written.
    ``per_file``: at most so many rows in a file, for rows so large that a reader cannot hold many; compressed more.
    """
    spark, path = df.sparkSession, new_work_path(df.sparkSession, label)
    before = spark.conf.get(FREE, "false")
    try:
        spark.conf.set(FREE, "true" if free else before)
        to = df.write.option("maxRecordsPerFile", per_file).option("compression", "zstd") if per_file else df.write
        to.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame) -> None:
    """Replaces what :func:`pinned` wrote by a table without rows: its disk is free again."""
    for path in {unquote(f).rsplit("/", 1)[0] for f in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and the text (null: empty).

    The two first columns are a row's key. Rows equal in both are copies of one
    another and share the outcome; an id that is null or used twice does no harm.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("text_hash"), text.alias("text"))


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns under names that no operator uses, and the columns to select to
    have them back. What an operator adds then cannot clash with what it passes through."""
    names = [f"passed_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column that holds no null."""
    return column.cast(pa.binary()).to_pylist()


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64) of every window of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, inverse = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    ahead = np.full(len(values), base, U64)
    ahead[0] = 1
    np.cumprod(ahead, out=ahead)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * ahead, out=sums[1:])
    back = np.full(n, inverse, U64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mixed((sums[size:] - sums[:n]) * back)
