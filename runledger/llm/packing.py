"""Best-fit packing into bins of several permitted sequence lengths.

Longest first, every piece goes to the open bin with the least room that holds it; if none
does, the bin size with the least cost per token expected in it is opened; in the end each bin
is cut down to the cheapest permitted length that holds its contents.

Pieces of equal length are interchangeable, so the packing is worked out on the histogram of
lengths (at most one row per token of the longest permitted length, whatever the number of
documents): runs of bins in the same state are filled together. Spark counts the lengths,
ranks the pieces of each length and looks every piece up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, pinned, table

SIZES = (512, 1024, 2048, 4096)
RANKED_TOGETHER = 20_000


def attention_cost(size: int) -> float:
    """Work of one sequence: linear layers and attention."""
    return size * (1 + size / 16_384)


class Plan(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank`` on go to bins from ``bin`` on, ``each`` to a
    bin, behind ``used`` tokens; bins from ``bin_start`` on have size ``bin_size``."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    used: np.ndarray
    bin_start: np.ndarray
    bin_size: np.ndarray


def planned(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = attention_cost) -> Plan:
    sizes = tuple(sorted(sizes))
    rooms: list[int] = []  # rooms of open bins, ascending
    open_runs: dict[int, list[tuple[int, int, int]]] = {}  # room: runs of bins (first, number, size)
    rows, bins = [], 0
    shorter = sum(n * c for n, c in histogram.items())

    def put(room: int, first: int, number: int, size: int) -> None:
        if number:
            if room not in open_runs:
                insort(rooms, room)
                open_runs[room] = []
            open_runs[room].append((first, number, size))

    def opened(length: int, count: int) -> int:
        def per_token(size: int) -> float:
            each = min(size // length, count)
            number = count // each
            return cost(size) / (each * length + min(size - each * length, shorter // number))

        return min((s for s in sizes if s >= length), key=per_token)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        shorter -= length * count
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                size = opened(length, count)
                number = max(1, count // (size // length))
                put(size, bins, number, size)
                bins += number
                continue
            room = rooms[at]
            first, number, size = open_runs[room].pop(0)
            if not open_runs[room]:
                del open_runs[room], rooms[at]
            each = room // length
            full = min(number, count // each)
            if not full:
                each, full = count, 1
            rows.append((length, rank, each, first, size - room))
            put(room, first + full, number - full, size)
            put(room - each * length, first, full, size)
            rank += each * full
            count -= each * full
    ends = sorted((first, size - room) for room, runs in open_runs.items() for first, _, size in runs)
    starts = np.array([x[0] for x in ends], np.int64)
    cut = np.array([min((s for s in sizes if s >= used), key=cost) for _, used in ends], np.int64)
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*columns, starts, cut)


def pieces(docs: DataFrame, longest: int) -> DataFrame:
    """(doc_id, n_tokens) to pieces of at most ``longest`` tokens: doc_id, piece, start, length."""
    number = F.ceil(F.col("n_tokens") / longest).cast("long")
    cut = docs.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("piece"))
    start = F.col("piece") * longest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(longest)).cast("long").alias("length"))


def packed(docs: DataFrame, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = attention_cost) -> DataFrame:
    """``docs``: doc_id and n_tokens. One row per piece: doc_id, piece, start (in the document),
    length, bin_id, bin_size, bin_offset.

    Rows of null or no tokens have no piece; documents above the longest size are cut at its
    multiples; every row counts, repeated and null ids too. An empty table gives no rows.
    """
    items = pinned(pieces(docs, max(sizes)), "pieces")
    salts = -(-max(1, items.count()) // RANKED_TOGETHER)
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = pinned(items.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = planned(histogram, sizes, cost)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(counts.select("length", "salt", before.alias("before")), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", (F.col("rank") + F.col("before")).alias("rank"))

    lengths = np.array(sorted(histogram), np.int64)
    base = np.cumsum([histogram[n] for n in lengths.tolist()] or [0]) - np.array([histogram[n] for n in lengths.tolist()] or [0])
    keys = base[np.searchsorted(lengths, plan.length)] + plan.rank if len(lengths) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(keys, base[np.searchsorted(lengths, length)] + rank, "right") - 1
            nth = rank - plan.rank[row]
            number = plan.bin[row] + nth // plan.each[row]
            size = plan.bin_size[np.searchsorted(plan.bin_start, number, "right") - 1]
            offset = plan.used[row] + nth % plan.each[row] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length")), pa.array(number), pa.array(size), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "bin_id", "bin_size", "bin_offset"])

    return ranked.mapInArrow(place, "doc_id long, piece long, start long, length long, bin_id long, bin_size long, bin_offset long")


def word_lengths(docs: DataFrame) -> DataFrame:
    """Tokens of a text: its words and one end token (null and empty texts: the end token)."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (words + 1).cast("long").alias("n_tokens"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return packed(word_lengths(docs))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
