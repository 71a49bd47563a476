"""Line dedup: of lines equal or within a few edits of one another, the first stays.

Equal lines are found whatever their length, if they hold a word: one aggregation by 64-bit hash.
Edits are allowed in proportion to the length: two from 40 characters, one from 20.
Distinct lines (by 64-bit hash) are joined on segments: a line is cut into ``edits`` + 1
segments, one of which any line within ``edits`` edits holds unchanged and nearly in place.
Every line is indexed by its own segments and probes, for every length it may be matched to,
the few start positions that the segment's place and the difference in length allow. Pairs
that meet must have nearly the same letter counts (an edit changes them by two at most), and are
confirmed by an edit distance that keeps one bit per diagonal and number of edits.
Links make components; the first line of a component, by document and place, stays.
Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, pinned, same_key, table
from .components import components
from .quality_rules import WORD, once

EDITS = 2
LEAST_CHARS = 40
LEAST_WORDS = 10
LETTERS = "entairsohd"


def lines(docs: DataFrame) -> DataFrame:
    """Lines that hold a word: doc_id, text_hash, line_no, line, id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(WORD)).withColumn("id", F.xxhash64("line"))


PLACE = ["doc_id", "text_hash", "line_no"]


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), *PLACE)


def letter_counts(line: str) -> Column:
    """The counts of some letters modulo 64, six bits each."""
    out = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(letter), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(n.cast("long").bitwiseAND(63), 6 * i))
    return out


def difference(a: str, b: str) -> Column:
    """By how much two sets of letter counts differ at least; an edit changes it by two at most."""
    out = F.lit(0)
    for i in range(len(LETTERS)):
        d = (F.shiftright(F.col(a), 6 * i) - F.shiftright(F.col(b), 6 * i)).bitwiseAND(63)
        out = out + F.least(d, 64 - d)
    return out


def keys(lines: DataFrame, places: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """(id, letters, key) of segments of ``lines`` (id, line, n, letters), one row for each of
    ``places``: (shorter, number, shift): segment ``number`` of a line by ``shorter`` characters
    shorter, looked up ``shift`` characters from its place. Key: hash of (length, number, text).

    A line is cut into edits + 1 segments; where its length does not divide, the last are longer by one."""
    wanted = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in places])
    rows = lines.select("id", "letters", "line", "n", F.inline(wanted))
    parts = edits + 1
    short, longer = f"cast((n - d) div {parts} as int)", f"cast((n - d) % {parts} as int)"
    rows = rows.selectExpr("*", f"{short} * i + greatest(0, i - {parts} + {longer}) + s AS start", f"{short} + if(i >= {parts} - {longer}, 1, 0) AS size")
    rows = rows.where("start >= 0 AND start + size <= n")
    return rows.selectExpr("id", "letters", "xxhash64(n - d, i, substring(line, start + 1, size)) AS key")


def own_places(edits: int) -> list[tuple[int, int, int]]:
    return [(0, i, 0) for i in range(edits + 1)]


def probed_places(edits: int) -> list[tuple[int, int, int]]:
    """For lines as long or up to ``edits`` shorter: the shifts that leave enough edits for both sides."""
    return [
        (d, i, s) for d in range(edits + 1) for i in range(edits + 1)
        for s in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)
    ]


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """The rows whose strings ``s`` and ``t`` are within ``edits`` edits of one another.

    A word of 2 * edits + 1 bits for every number of edits says on which diagonals the prefixes
    read so far can be matched with that many edits."""
    width = 2 * edits + 1
    full, step = (1 << width) - 1, width + 1
    rows = once(pairs, s_chars=F.split("s", ""), t_chars=F.split("t", ""))
    agree = lambda c, i: sum(
        (F.when((F.get("t_chars", i + (d - edits)) == c).eqNullSafe(True), 1 << d).otherwise(0) for d in range(1, width)),
        F.when((F.get("t_chars", i - edits) == c).eqNullSafe(True), 1).otherwise(0))

    def read(state: Column, same: Column) -> Column:
        words = [F.shiftrightunsigned(state, step * e).bitwiseAND(full) for e in range(edits + 1)]
        out, less = [], None
        for e, w in enumerate(words):
            now = w.bitwiseAND(same)
            if e:
                now = now.bitwiseOR(words[e - 1]).bitwiseOR(F.shiftright(words[e - 1], 1)).bitwiseOR(F.shiftleft(less, 1)).bitwiseAND(full)
            out.append(now)
            less = now
        packed = out[0]
        for e in range(1, edits + 1):
            packed = packed.bitwiseOR(F.shiftleft(out[e], step * e))
        return packed

    first = sum(sum(1 << (edits + k) for k in range(e + 1)) << (step * e) for e in range(edits + 1))
    last = F.aggregate(F.transform("s_chars", agree), F.lit(first), read)
    diagonal = F.size("t_chars") - F.size("s_chars") + edits
    rows = once(rows, last=last, diagonal=diagonal).where((F.col("diagonal") >= 0) & (F.col("diagonal") < width))
    hit = F.lit(0)
    for e in range(edits + 1):
        hit = hit.bitwiseOR(F.expr(f"shiftrightunsigned(last, diagonal + {step * e})").bitwiseAND(1))
    return rows.where(hit == 1).drop("s_chars", "t_chars", "last", "diagonal")


def links(found: DataFrame, edits: int) -> DataFrame:
    """(a, b): ids of distinct lines within ``edits`` edits (7 at most)."""
    # all readers of the distinct lines use the same columns, so that they share one shuffle
    distinct = found.select("id", "line", letter_counts("line").alias("letters")).groupBy("id").agg(F.any_value("line").alias("line"), F.max("letters").alias("letters"))
    distinct = distinct.where("letters >= 0 AND line IS NOT NULL")
    # the length modulo 8 above the letter counts tells pairs of equal length, which meet from both sides
    marked = distinct.select("id", "letters", "line", F.char_length("line").alias("n"))
    marked = marked.withColumn("letters", F.col("letters").bitwiseOR(F.shiftleft((F.col("n") % 8).cast("long"), 60)))
    own = keys(marked, own_places(edits), edits).toDF("a", "letters_a", "key")
    probes = keys(marked, probed_places(edits), edits).toDF("b", "letters_b", "key")
    once_only = (F.shiftright("letters_a", 60) != F.shiftright("letters_b", 60)) | (F.col("a") < F.col("b"))
    met = own.join(probes, "key").where((F.col("a") != F.col("b")) & once_only & (difference("letters_a", "letters_b") <= 2 * edits))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    s, t = (distinct.select(F.col("id").alias(k), F.col("line").alias(name)) for k, name in (("a", "s"), ("b", "t")))
    return within(pairs.join(s, "a").join(t, "b"), edits).select("a", "b")


def near_links(found: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """(a, b): ids of distinct lines within ``edits`` edits from ``least_chars`` characters, and
    within e edits from e / edits times as many."""
    out, n = None, F.char_length("line")
    for e in range(1, edits + 1) if edits else [0]:
        part = found.where(n >= -(-least_chars * e // max(edits, 1)))
        if e < edits:  # pairs of longer lines are found with more edits
            part = part.where(n < -(-least_chars * (e + 1) // edits) + e)
        out = links(part, e) if out is None else out.unionByName(links(part, e))
    return out


def removals(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, removed: the numbers (from 0) of the lines to remove, for every document
    that has any. Shorter lines than ``least_chars`` characters go with fewer edits, the shortest
    only if equal; lines without a word never go."""
    labels = components(pinned(near_links(lines(docs), edits, least_chars), "line-links", free=True))
    found = pinned(lines(docs).drop("line"), "lines")
    ids = found.groupBy("id").agg(F.min(place()).alias("first"), F.count("*").alias("n"))
    ids = ids.join(labels, ids["id"] == labels["node"], "left").select("id", "first", "n", F.coalesce("component", "id").alias("component"))
    ids = pinned(ids.where("n > 1 OR component <> id").unionByName(ids.where("n = 1 AND component = id").join(labels.select("component").distinct(), "component", "left_semi")), "repeated-lines", free=True)
    first = ids.groupBy("component").agg(F.min("first").alias("stays"))
    again = found.join(ids.join(first, "component").select("id", "stays"), "id").where(place() != F.col("stays"))
    return again.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, **settings) -> DataFrame:
    """``docs`` without repeated lines, n_chars (if there) brought up to date, other columns as they are.

    A document that loses lines and keeps fewer than ``least_words`` words goes as a whole. Null
    and empty texts have no lines and stay. Rows equal in id and text share one outcome; a null
    id comes last in the order of documents. An empty table stays empty.
    """
    passed, back = aside(docs)
    column = dict(zip(docs.columns, passed.columns))
    passed = passed.withColumn("doc_id", F.col(column["doc_id"]).cast("long")).withColumn("text_hash", F.hash(F.coalesce(F.col(column["text"]), F.lit(""))))
    gone = removals(docs, **settings)
    rows = passed.join(gone, same_key(passed, gone), "left").drop("doc_id", "text_hash")
    left = F.array_join(F.filter(F.split(column["text"], "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    rows = once(rows, kept_text=F.when(F.col("removed").isNull(), F.col(column["text"])).otherwise(left))
    rows = rows.where(F.col("removed").isNull() | (F.regexp_count("kept_text", F.lit(WORD)) >= least_words))
    changes = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("removed").isNull(), F.col(column["n_chars"])).otherwise(F.char_length("kept_text"))
        changes["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[changes[n].alias(n) if n in changes else c for n, c in zip(docs.columns, back)])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", "text", F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    counted = counted.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("text_hash"), "n_lines")
    gone = removals(docs)
    rows = counted.join(gone, same_key(counted, gone), "left").select(counted["doc_id"], "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))
