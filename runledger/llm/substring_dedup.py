"""Substring dedup: hashes of every fixed-length word window, counted over all documents.

Every window of ``size`` words gets a Rabin-Karp hash; Spark deals the hashes by range and
those found twice or more name their windows; the windows of a document merge into maximal
runs, which are removed. Windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keyed, ranges, same_key, table, text_bytes, window_hashes, word_hashes
from .repeats import covered, repeated_places

WINDOW = 35


def windows_of(size: int):
    def hasher(texts: list[bytes]):
        words = [t.split() for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        flat = window_hashes(word_hashes(x for w in words for x in w), size)
        counts = np.maximum(n - size + 1, 0)
        places = ranges(counts)
        starts = np.repeat(np.cumsum(n) - n, counts) + places
        return flat[starts] if len(starts) else np.zeros(0, U64), places, counts

    return hasher


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
    return edges[::2], edges[1::2]


def substring_dedup(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (removed runs of words,
    end exclusive), text (words kept, joined by one space).

    Null or empty texts have no words; texts shorter than the window lose nothing. Rows with
    equal id and text count as two occurrences, like any copies. An empty table gives no rows;
    other columns than doc_id and text are not read.
    """
    rows = keyed(docs)
    expected = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeated_places(rows, windows_of(size), expected // 6)
    joined = rows.join(found, same_key(rows, found), "left").select(rows["doc_id"], rows["text"], found["places"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, lists in zip(text_bytes(batch.column("text")), batch.column("places").to_pylist()):
                words = text.split()
                if not lists:
                    out.append((len(words), 0, [], b" ".join(words)))
                    continue
                mask = covered(lists, size, len(words))
                a, b = runs(mask)
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(a, b)]
                out.append((len(words), int(mask.sum()), spans, b" ".join([w for w, m in zip(words, mask.tolist()) if not m])))
            n, gone, spans, kept = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "text"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, list_aggregate(w[i : i + {WINDOW - 1}], 'string_agg', ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) AS i FROM d)),
k AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM k, (SELECT unnest(range({WINDOW})) AS j)),
u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, g.i IS NULL AS stays, w[i] AS x FROM u LEFT JOIN g USING (doc_id, i)),
r AS (SELECT doc_id, CAST(count(*) FILTER (NOT stays) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (stays), '')) AS kept_sha256,
  CAST(count(*) FILTER (NOT stays AND before) AS BIGINT) AS n_spans
  FROM (SELECT *, lag(stays, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN r USING (doc_id)"""
