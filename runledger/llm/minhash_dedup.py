"""MinHash near-dedup with bottom-k sketches from one hash function.

1. One pass gives every document its distinct word shingles: their number, a digest of the
   whole set, and the k smallest hashes (the sketch). Equal sets are one class from here on.
2. Inverted lists of retained values give candidate pairs. Values are ordered by how many
   sketches hold them; two sketches that share t values share one among the first
   (size - t + 1) of either, so only these are indexed and passages held by many documents
   rarely are.
3. First each list compares its members with one pivot, the member whose values are the most
   common (in a family of copies: the one they stem from). Members linked through it need no
   comparison with each other. Members of lists that still hold several components are then
   joined on their full sets with exact prefixes: two sets of given sizes that reach the
   threshold share a value near the rare end of both. A copy too far from its family's origin
   has only values of its own there, so a family does not turn into all its pairs.
4. Pairs are compared by the share of common values in the k smallest of the union of both
   sketches, and confirmed on the full shingle sets of both texts.

t and the estimate's bound lie so low (about 5.5 standard deviations below the share that a
link implies) that the chance to miss a link at the very threshold is around 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import U64, keyed, mixed, pinned, ranges, same_key, table, text_bytes, window_hashes, word_hashes
from .components import components

SHINGLE = 5
THRESHOLD = 75  # percent
K = 64
LEAST_COMMON = 28


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    words = [t.lower().split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    values = word_hashes(x for w in words for x in w)
    flat = window_hashes(values, size)
    starts = np.cumsum(n) - n
    out = []
    for at, m in zip(starts.tolist(), n.tolist()):
        if m >= size:
            out.append(np.unique(flat[at : at + m - size + 1]))
        elif m:
            out.append(mixed(window_hashes(values[at : at + m], m) + U64(m)))
        else:
            out.append(np.zeros(0, U64))
    return out


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                sets = shingle_sets(text_bytes(piece.column("text")), size)
                low = [s[:k] for s in sets]
                ends = np.cumsum([0] + [len(x) for x in low])
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(low or [np.zeros(0, U64)]).view(np.int64)))],
                    names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"])

    return keyed(docs).mapInArrow(sketch, "doc_id long, text_hash int, n_shingles long, digest binary, sketch array<long>")


def near_in_size(a: str, b: str, threshold: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def estimated(pairs: DataFrame, nodes: DataFrame, k: int, least: int) -> DataFrame:
    """Pairs (a, b) with the number of common values among the k smallest of their union,
    scaled to k; only those of at least ``least``."""
    x, y = (nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"s_{c}")) for c in "ab")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.zeros(batch.num_rows, np.int32)
            for i, (p, q) in enumerate(zip(batch.column("s_a"), batch.column("s_b"))):
                p, q = (np.asarray(v.values).view(U64) for v in (p, q))
                both = np.sort(np.concatenate([p, q]))
                same = np.r_[both[1:] == both[:-1], False]
                first = np.r_[True, ~same[:-1]]
                low = same[first][:k]
                share[i] = int(low.sum()) * k // max(len(low), 1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], names=["a", "b", "share"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", "s_a", "s_b").mapInArrow(estimate, "a long, b long, share int").where(F.col("share") >= least)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    x, y = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab")

    def words_of(text: bytes) -> set:
        w = text.lower().split()
        return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)}

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set] = {}
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                for a, s, t in zip(piece.column("a").to_pylist(), text_bytes(piece.column("t_a")), text_bytes(piece.column("t_b"))):
                    if a not in held:
                        if len(held) >= 4:
                            held.clear()
                        held[a] = words_of(s)
                    p, q = held[a], words_of(t)
                    same = len(p & q)
                    keep.append(100 * same >= threshold * (len(p) + len(q) - same))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "t_a", "t_b").mapInArrow(confirm, "a long, b long")


def close_in_full(texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Pairs (a, b), a < b, of ``texts`` (node, component, text) in different components whose
    full sets may reach the threshold, by prefixes in order of rarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                found = shingle_sets(text_bytes(piece.column("text")), size)
                ends = np.cumsum([0] + [len(x) for x in found])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("node"), piece.column("component"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))],
                    names=["node", "component", "shingles"])

    values = texts.select("node", "component", "text").mapInArrow(sets, "node long, component long, shingles array<long>")
    values = values.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("value"))
    values = values.repartition("value").withColumn("df", F.count("*").over(W.partitionBy("value"))).where("df > 1")
    of_node = W.partitionBy("node")
    values = values.withColumn("shared", F.count("*").over(of_node)).withColumn("at", F.col("n") - F.col("shared") + F.row_number().over(of_node.orderBy("df", "value")))
    values = values.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1).drop("df", "shared")
    x = values.toDF("a", "c_a", "n_a", "value", "at_a")
    y = values.toDF("b", "c_b", "n_b", "value", "at_b")
    common = F.ceil((F.col("n_a") + F.col("n_b")) * threshold / (100 + threshold))
    return (
        x.join(y, "value")
        .where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & near_in_size("n_a", "n_b", threshold))
        .where((F.col("at_a") <= F.col("n_a") - common + 1) & (F.col("at_b") <= F.col("n_b") - common + 1))
        .select("a", "b").distinct()
    )


def near_duplicates(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, k: int = K, least_common: int = LEAST_COMMON) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept.

    A null or empty text has no shingles and no links. A document with a null id can be linked
    but never gives a component its id; it is kept if its component has no id at all. Rows that
    share an id are judged by their own text. Equal rows share one outcome. An empty table gives
    no rows. Other columns than doc_id and text are not read.
    """
    all_docs = pinned(sketches(docs, size, k), "sketches")
    members = all_docs.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "digest")
    node = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long").alias("node")
    classes = members.groupBy("digest", "n_shingles").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("rep"))
    classes = pinned(classes.select("digest", node, "n_shingles", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash")), "classes")
    c = classes.select("node", "n_shingles", F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash"), F.col("digest").alias("rep_digest"))
    nodes = pinned(
        all_docs.join(c, (all_docs["digest"] == c["rep_digest"]) & all_docs["doc_id"].eqNullSafe(c["rep_id"]) & (all_docs["text_hash"] == c["rep_hash"]))
        .select("node", c["n_shingles"], "sketch").dropDuplicates(["node"]), "nodes")

    values = nodes.select("node", F.col("n_shingles").alias("n"), F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    values = values.repartition("value").withColumn("df", F.count("*").over(W.partitionBy("value"))).where("df > 1")
    of_node = W.partitionBy("node")
    whole = F.ceil(F.col("n") * threshold / 100)
    needed = F.when(F.col("n") * 100 <= k * threshold, whole).otherwise(F.least(whole, F.lit(least_common)))
    lists = pinned(
        values.withColumn("rank", F.row_number().over(of_node.orderBy("df", "value")))
        .withColumn("shared", F.count("*").over(of_node))
        .withColumn("score", F.sum("df").over(of_node))
        .where(F.col("held") - F.col("shared") + F.col("rank") <= F.col("held") - needed + 1)
        .select("value", "node", "n", "score"), "lists")

    pivots = lists.groupBy("value").agg(F.max(F.struct("score", "node", "n")).alias("p"), F.count("*").alias("m")).where("m > 1").select("value", F.col("p.node").alias("a"), F.col("p.n").alias("n_a"))
    to_pivot = (
        lists.join(pivots, "value").where((F.col("node") != F.col("a")) & near_in_size("n", "n_a", threshold))
        .select("a", F.col("node").alias("b")).distinct()
    )
    first = estimated(to_pivot, nodes, k, least_common)
    best = first.groupBy("b").agg(F.max(F.struct("share", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    best = pinned(best, "pairs")

    rows = keyed(docs)
    named = classes.select("node", "doc_id", "text_hash").join(lists.select("node").distinct(), "node")
    texts = pinned(rows.join(named, same_key(rows, named)).select("node", "text").dropDuplicates(["node"]), "texts")
    links = pinned(confirmed(best, texts, size, threshold), "confirmed")
    labels = components(links)

    placed = lists.join(labels, "node", "left").select("value", "node", F.coalesce("component", "node").alias("component"))
    still_open = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("value")
    open_nodes = placed.join(still_open, "value").select("node", "component").distinct()
    rest = pinned(close_in_full(texts.join(open_nodes, "node"), size, threshold).join(best, ["a", "b"], "left_anti"), "rest")
    more = confirmed(estimated(rest, nodes, k, least_common), texts, size, threshold)
    labels = components(links.union(more))

    names = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = names.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = names.join(ids, "component").select("digest", "component_id")
    return all_docs.join(names, "digest", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that represent their component, all columns as they are."""
    gone = near_duplicates(docs, **settings).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    text_hash = F.hash(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (text_hash == gone["gone_hash"]), "left_anti")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
