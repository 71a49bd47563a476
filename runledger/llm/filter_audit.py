"""What each filter of a cascade removes, in every order in which the filters can be applied.

A document fails a set of filters; with five filters there are 32 such sets. Let ``fails`` be the
matrix of sets by filters, 0 where the set holds the filter and infinite elsewhere, and ``places``
the matrix of filters by orders that holds the inverse permutations: the step at which an order
applies a filter. Their product under minimum and sum is the removal step of every set in every
order. The counts of documents per set are then scattered by that step, once for each weight
(all documents, good ones, toxic ones); what fails a filter at a later step than its removal is
redundant there.

Spark works out the set of every document and counts the sets per part; the 120 orders are only
looked at per part and set, never per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_bytes

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
LEAST_WORDS = 200
NEVER = len(FILTERS) + 1
WEIGHTS = ("documents", "good", "toxic")
ROW = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
UPPER, MARKS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"


@cache
def orders() -> tuple[list[str], np.ndarray]:
    """All orders, and the filter (by number) that each applies at each step."""
    found = list(permutations(range(len(FILTERS))))
    return ["".join(FILTERS[i] for i in p) for p in found], np.array(found)


@cache
def removal_steps() -> np.ndarray:
    """Sets by orders: the step, from 1 on, that removes a document; NEVER if none does."""
    member = np.arange(SETS)[:, None] >> np.arange(len(FILTERS)) & 1
    fails = np.where(member, 0, NEVER)
    places = np.argsort(orders()[1], axis=1).T + 1
    return np.minimum((fails[:, :, None] + places[None, :, :]).min(axis=1), NEVER)


def audited(weights: np.ndarray) -> dict[str, np.ndarray]:
    """``weights``: WEIGHTS by sets. Counts as arrays of orders by steps."""
    rank, (_, applied) = removal_steps(), orders()
    number, steps = len(applied), len(FILTERS)

    def scattered(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((number, NEVER), np.int64)
        np.add.at(out, (np.arange(number)[None, :], rank - 1), weight[:, None])
        return out[:, :steps]

    documents, good, toxic = weights
    removed = scattered(documents)
    member = (np.arange(SETS)[:, None] >> np.arange(steps) & 1).astype(bool)
    failing, only = member.T @ documents, documents[1 << np.arange(steps)]
    fails_at = failing[applied]  # orders by steps: documents that fail the step's filter, removed earlier or not
    shapley = np.zeros(steps, np.int64)
    np.add.at(shapley, applied, removed)
    return {
        "kept": documents.sum() - np.cumsum(removed, axis=1), "removed": removed, "redundant": fails_at - removed,
        "unique_fails": only[applied], "good_lost": scattered(good), "toxic_lost": scattered(toxic), "shapley": shapley[applied],
    }


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and the filters A to D that it fails as bits of ``mask``."""

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, chars in zip(text_bytes(batch.column("text")), batch.column("n_chars").to_pylist()):
                words = raw.split()
                out.append(
                    (len(words) < LEAST_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1
                    | (100 * (len(raw) - len(raw.translate(None, UPPER))) > 3 * chars) << 2
                    | (len(raw.translate(None, MARKS)) < len(raw)) << 3
                )
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "digest")), pa.array(out, pa.int32())], names=["doc_id", "part", "digest", "mask"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"),
                       F.unhex(F.sha2(text, 256)).alias("digest"), F.char_length(text).alias("n_chars"), text.alias("text"))
    return rows.mapInArrow(masks, "doc_id long, part string, digest binary, mask int")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``, 1 if any label row of the id says so."""
    of_id = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return rows.join(of_id, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def counted(rows: DataFrame) -> DataFrame:
    """Documents per part, set of failed filters and label.

    A document fails E if its text stands under a smaller id anywhere. Rows equal in id and text are
    counted first, so that a text of a third of all rows is spread over the tasks; what is then left of a text
    is a row for each of its parts and labels, with how many rows bear its least id.
    """
    alike = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy(*alike, "doc_id").agg(F.count("*").alias("n"))
    held = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.sum(F.when(held, F.col("n"))).alias("with_id"),
        F.min(F.when(held, F.struct("doc_id", "n"))).alias("least"))
    anywhere = by_text.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    first = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    copies = F.coalesce(F.col("with_id") - first, F.lit(0))
    both = by_text.join(anywhere, "digest").select("part", "mask", "good", "toxic", "n", copies.alias("copies"))
    repeated = 1 << FILTERS.index("E")
    sides = F.array(F.struct(F.col("mask").alias("fails"), (F.col("n") - F.col("copies")).alias("documents")),
                    F.struct((F.col("mask") + repeated).alias("fails"), F.col("copies").alias("documents")))
    return both.select("part", "good", "toxic", F.inline(sides)).groupBy("part", "fails", "good", "toxic").agg(F.sum("documents").alias("documents"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``: doc_id, text, lang; ``labels``: doc_id, quality, toxic. For each part (lang value, null: empty),
    order of the filters and step: what the step's filter keeps, removes, would remove again, ... (see ROW).

    The filters: A under 200 words, B less than half of the words distinct, C over 3 % capital
    letters A-Z, D any of ``#$%&*|``, E a text that stands under a smaller id too. Null texts are
    empty ones. Rows without an id fail E never, as nothing is smaller, and have no labels; rows with
    an id used twice count each, and share its labels (1 if any label row says 1). Equal texts are told
    by their SHA-256. A table without rows has no parts. Other columns are not looked at.
    """
    counts = counted(with_labels(judged(docs), labels))
    weight = {"documents": F.col("documents"), "good": F.col("documents") * F.col("good"), "toxic": F.col("documents") * F.col("toxic")}
    wide = counts.groupBy("part").agg(*[F.array(*[F.sum(F.when(F.col("fails") == m, w).otherwise(0)) for m in range(SETS)]).alias(n) for n, w in weight.items()])

    def all_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, applied = orders()
        steps = len(FILTERS)
        for batch in batches:
            for row in batch.to_pylist():
                counts = audited(np.array([row[w] for w in WEIGHTS], np.int64))
                size = applied.size
                columns = {"part": [row["part"]] * size, "filter_order": np.repeat(names, steps).tolist(),
                           "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names))}
                yield pa.RecordBatch.from_pydict(columns | {n: c.ravel() for n, c in counts.items()})

    return wide.mapInArrow(all_orders, ROW)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


W_SQL = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH RECURSIVE measured AS (
  SELECT doc_id, coalesce(lang, '') AS part, t, regexp_extract_all(t, '{W_SQL}') AS w
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
flags AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic, [
    len(w) < {LEAST_WORDS}, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
    regexp_matches(t, '[#$%&*|]'), d.doc_id > min(d.doc_id) OVER (PARTITION BY t)] AS fails
  FROM measured d LEFT JOIN labels l ON d.doc_id = l.doc_id),
docs AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM flags GROUP BY ALL),
perms(o) AS (SELECT '' UNION ALL SELECT o || f FROM perms, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE o NOT LIKE '%' || f || '%'),
steps AS (SELECT o, s, ascii(o[s]) - 64 AS f FROM perms, range(1, 6) r(s) WHERE length(o) = 5),
gone AS (SELECT part, o, d.fails, d.n, d.g, d.x, min(s) FILTER (d.fails[f]) AS gone_at FROM docs d, steps GROUP BY ALL),
counts AS (
  SELECT part, s.o, s.s, s.f, sum(n) FILTER (gone_at IS NULL OR gone_at > s) AS kept, sum(n) FILTER (gone_at = s) AS removed,
    sum(n) FILTER (fails[f] AND gone_at < s) AS redundant,
    sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
    sum(g) FILTER (gone_at = s) AS good_lost, sum(x) FILTER (gone_at = s) AS toxic_lost
  FROM gone JOIN steps s ON gone.o = s.o GROUP BY part, s.o, s.s, s.f)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step,
  {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM counts"""
