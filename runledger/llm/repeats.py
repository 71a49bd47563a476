"""Which hashes of which documents occur more than once, with one large shuffle of packed blocks.

Each map task packs the hashes of a block of documents by hash range: seven bytes of hash and
about one byte of place each. A task of the second stage gets all packed hashes of one range,
sorts them and names those found twice or more by block and place; a third stage turns the
places of a block into positions of its documents. A hash repeated within a block is settled
there and sent once, so a hash that a third of all documents hold reaches its range once per
block. Blocks are named by their content, so a task that runs again names them alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, text_bytes

PACKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("at", pa.binary()), ("hashes", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])
PACKED_DDL = "part long, block long, at binary, hashes binary, docs binary, counts binary, places binary"
FOUND_DDL = "block long, at binary, docs binary, counts binary, places binary"
KEY = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("text_hash", "<i4")])
BLOCK = 1_000_000
PER_PART = 2_000_000

#: For a list of texts: the hashes of all in a row, their positions in their texts, and how many each text has.
Hasher = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def planes(x: np.ndarray) -> bytes:
    """Byte planes of 32-bit numbers: the upper ones are mostly zero and shrink in the shuffle."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def ascending(b: bytes) -> np.ndarray:
    return np.cumsum(unplaned(b))


def block_rows(keys: np.ndarray, counts: np.ndarray, places: np.ndarray, hashes: np.ndarray, parts: int) -> Iterator[tuple]:
    block = int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "big") >> 1
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    again, known = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    again[order[1:][same]] = True
    known[order[1:][same]] = True
    known[order[:-1][same]] = True
    del order, same
    steps = planes(np.diff(places, prepend=0) & 0xFFFFFFFF)
    yield parts + block % parts, block, planes(np.diff(np.flatnonzero(known), prepend=0)), b"", keys.tobytes(), planes(counts), steps
    sent = np.flatnonzero(~again)
    part = (((hashes[sent] >> U64(40)) * U64(parts)) >> U64(24)).astype(np.int32)
    by_part = np.argsort(part, kind="stable")
    sent, part = sent[by_part], part[by_part]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
        x = sent[a:b]
        raw = np.ascontiguousarray(hashes[x].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()
        yield int(part[a]), block, planes(np.diff(x, prepend=0)), raw, b"", b"", b""


def of_part(rows: pd.DataFrame) -> pd.DataFrame:
    """The hashes of one part that occur twice or more, by block and place; block tables pass."""
    told = rows[rows.hashes.str.len() == 0]
    out = list(told[["block", "at", "docs", "counts", "places"]].itertuples(index=False, name=None))
    sent = rows[rows.hashes.str.len() > 0]
    if len(sent):
        sizes = sent.hashes.str.len().to_numpy() // 7
        ends = np.cumsum(sizes)
        raw = np.zeros((ends[-1], 8), np.uint8)
        for e, n, b in zip(ends, sizes, sent.hashes):
            raw[e - n : e, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
        h = raw.view("<u8").ravel()
        order = np.argsort(h)
        h = h[order]
        same = h[1:] == h[:-1]
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        for e, n, block, at in zip(ends, sizes, sent.block, sent["at"]):
            mine = hit[e - n : e]
            if mine.any():
                out.append((block, planes(np.diff(ascending(at)[mine], prepend=0)), b"", b"", b""))
    return pd.DataFrame(out, columns=["block", "at", "docs", "counts", "places"]).astype({"block": "int64"})


def of_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents of one block with the positions of their repeated hashes."""
    table = rows[rows.docs.str.len() > 0].iloc[0]
    keys, counts = np.frombuffer(table.docs, KEY), unplaned(table.counts)
    places = (np.cumsum(unplaned(table.places)) & 0xFFFFFFFF).astype("<u4")
    hit = np.zeros(len(places), bool)
    for at in rows["at"]:
        if at:
            hit[ascending(at)] = True
    ends = np.cumsum(counts)
    got = np.add.reduceat(np.r_[hit, False].astype(np.int64), ends - counts) * (counts > 0)
    out = [
        (None if k["null"] else int(k["doc_id"]), int(k["text_hash"]), places[e - c : e][hit[e - c : e]].tobytes())
        for k, c, e, n in zip(keys, counts, ends, got) if n
    ]
    return pd.DataFrame({"doc_id": pd.array([x[0] for x in out], "Int64"), "text_hash": np.array([x[1] for x in out], np.int32), "places": [x[2] for x in out]})


def repeated_places(rows: DataFrame, hasher: Hasher, expected: int) -> DataFrame:
    """``rows`` as of :func:`common.keyed`; gives doc_id, text_hash and a list of binaries of
    32-bit positions, one row per document that has a hash found twice or more.

    ``expected`` is about how many hashes there will be; it sets the number of hash ranges.
    """
    parts = max(2, -(-expected // PER_PART))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            keys, counts, places, hashes = (np.concatenate(x) for x in zip(*held))
            cols = zip(*block_rows(keys, counts, places, hashes, parts))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PACKED)], schema=PACKED)

        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                piece = batch.slice(at, 250)
                hashes, places, counts = hasher(text_bytes(piece.column("text")))
                keys = np.zeros(piece.num_rows, KEY)
                keys["null"] = piece.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                keys["doc_id"] = piece.column("doc_id").fill_null(0).to_numpy()
                keys["text_hash"] = piece.column("text_hash").to_numpy()
                if len(hashes):
                    held.append((keys, counts, places, hashes))
                    size += len(hashes)
                if size >= BLOCK:
                    yield flushed()
                    held, size = [], 0
        if held:
            yield flushed()

    found = (
        rows.mapInArrow(pack, PACKED_DDL)
        .repartition(2 * parts, "part")
        .groupBy("part")
        .applyInPandas(of_part, FOUND_DDL)
        .groupBy("block")
        .applyInPandas(of_block, "doc_id long, text_hash int, places binary")
    )
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list("places").alias("places"))


def covered(lists: list[bytes] | None, size: int, n: int) -> np.ndarray:
    """Mask of the ``n`` positions that a window of ``size`` starting at a listed position covers."""
    steps = np.zeros(n + 1, np.int64)
    for b in lists or ():
        at = np.frombuffer(b, "<u4").astype(np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, np.minimum(at + size, n), -1)
    return np.cumsum(steps[:n]) > 0
