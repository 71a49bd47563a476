"""SimHash near duplicates by anchor-point covering.

Anchors are the words of a covering code: every fingerprint lies within the code's covering radius
of one anchor, its home. Two fingerprints that differ in at most ``DIFFERENT`` bits then meet at the
home of either, if each is replicated to every anchor within the covering radius plus that number.

The code is a product of two perfect Golay codes over bits 0-22 and 23-45 of the fingerprint (the
other bits only take part in the comparison): 2**24 anchors, covering radius 3 in each half, each
word with one home. The differing bits of a pair are shared out between the halves, so a
fingerprint goes to the anchors within 3 + a of its one half and 3 + b of the other, a + b being
at most the threshold: 302 on average. Copies go through this once, as one fingerprint.

Spark deals homes and replicas by anchor and compares them there, links in one direction only;
components of linked fingerprints are found by star steps. An anchor that many fingerprints share is an ordinary
skewed join key, which Spark may split. Nothing but the plan passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, ranges, table, text_bytes
from .components import components

SHINGLE = 3
SEED = 42
DIFFERENT = 3
RADIUS = 3
# a fixed value: generator polynomial of the binary Golay code of length 23
GOLAY = 0b110001110101
LENGTH, REDUNDANT = 23, 11
SLICE_BYTES = 1 << 20


def word_slices(data: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in order, some ``size`` bytes at a time."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeats included."""
    ones, number, words = np.zeros(64, np.int64), 0, []

    def count(shingles: Iterable[bytes]) -> int:
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones[:] += bits.sum(axis=0, dtype=np.int64)
        return len(hashes)

    for more in word_slices(text):
        words = words[-(size - 1) :] + [w.lower() for w in more] if size > 1 else [w.lower() for w in more]
        number += count(map(b" ".join, zip(*(words[k:] for k in range(size)))))
    if not number and words:
        number = count([b" ".join(words)])
    return int.from_bytes(np.packbits(2 * ones > number).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a signed long, of every row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter(map(fingerprint, text_bytes(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(marked, "doc_id long, bits long")


@cache
def remainders() -> np.ndarray:
    """The remainder of every 23-bit word, as tables for its three bytes."""
    tables = np.zeros((3, 256), np.int64)
    for byte in range(3):
        words = np.arange(256, dtype=np.int64) << (8 * byte)
        for bit in range(LENGTH, REDUNDANT - 1, -1):
            words = np.where(words >> bit & 1, words ^ (GOLAY << (bit - REDUNDANT)), words)
        tables[byte] = words
    return tables


def remainder(words: np.ndarray) -> np.ndarray:
    t = remainders()
    return t[0][words & 255] ^ t[1][words >> 8 & 255] ^ t[2][words >> 16]


@cache
def offsets(beyond: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differences to the anchors that are ``beyond`` bits further off than the covering radius
    (0: within it), sorted by remainder; where those of each remainder start; and how many there are."""
    sizes = range(RADIUS + 1) if beyond == 0 else [RADIUS + beyond]
    words = np.array([sum(1 << b for b in bits) for n in sizes for bits in combinations(range(LENGTH), n)], np.int64)
    kinds = remainder(words)
    number = np.bincount(kinds, minlength=1 << REDUNDANT)
    return words[np.argsort(kinds, kind="stable")], np.cumsum(number) - number, number


def halves(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (1 << LENGTH) - 1
    return bits & low, bits >> LENGTH & low


def anchors(bits: np.ndarray, different: int) -> tuple[np.ndarray, np.ndarray]:
    """Every anchor within the covering radius plus ``different``: places in ``bits``, and anchors."""
    one, two = halves(bits)
    kind_one, kind_two = remainder(one), remainder(two)
    rows, found = [], []
    for a in range(different + 1):
        for b in range(different + 1 - a):
            (words_a, first_a, count_a), (words_b, first_b, count_b) = offsets(a), offsets(b)
            of_b = count_b[kind_two]
            total = count_a[kind_one] * of_b
            row, nth = np.repeat(np.arange(len(bits)), total), ranges(total)
            i, j = nth // np.repeat(of_b, total), nth % np.repeat(of_b, total)
            word_a = one[row] ^ words_a[first_a[kind_one][row] + i]
            word_b = two[row] ^ words_b[first_b[kind_two][row] + j]
            rows.append(row)
            found.append((word_a >> REDUNDANT) << (LENGTH - REDUNDANT) | word_b >> REDUNDANT)
    return np.concatenate(rows), np.concatenate(found)


def at_anchors(prints: DataFrame, different: int) -> DataFrame:
    """``prints`` (bits) replicated: anchor, bits. With ``different`` 0 every fingerprint is at its home only."""

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                bits = batch.column("bits").slice(part, 1000).to_numpy()
                row, anchor = anchors(bits, different)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(bits[row])], names=["anchor", "bits"])

    return prints.select("bits").mapInArrow(replicated, "anchor int, bits long")


def links(prints: DataFrame, different: int = DIFFERENT) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most ``different`` bits, a below b."""
    homes = at_anchors(prints, 0).select("anchor", F.col("bits").alias("a"))
    all_of = at_anchors(prints, different).select("anchor", F.col("bits").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= different
    return all_of.join(homes.hint("shuffle_hash"), "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, different: int = DIFFERENT) -> DataFrame:
    """``docs``: doc_id, text. Per row doc_id, fingerprint, component_id: the smallest doc_id reachable
    over fingerprints that differ in at most ``different`` bits.

    Texts without words, null texts too, have fingerprint zero and are linked like any other. Rows
    with a null or repeated id each keep their row; null ids are never the smallest, so a component
    of nothing else has a null component_id. Other columns are not looked at; no rows give no rows.
    """
    found = pinned(fingerprints(docs), "simhash")
    prints = pinned(found.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    linked = components(links(prints, different))
    root = F.coalesce("component", "bits").alias("root")
    rooted = pinned(prints.join(linked, F.col("bits") == F.col("node"), "left").select("bits", "least", root), "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("bits", "component_id")
    return found.join(by_print, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
