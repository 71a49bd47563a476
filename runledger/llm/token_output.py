"""Token ids as directly addressable codes in binary files.

Every id is cut into 8-bit chunks. Level 0 holds the lowest chunk of all ids, level k the
k-th chunk of those ids that have one; a bitmap per level says which ids go on, and a rank
directory (ones before every 512th bit) leads from a place in a level to the place in the
next one. So any token can be read without decoding others. A file is one shard: a header,
document ids and ends, the levels; the writer ends it with a line feed.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import new_work_path
from .common import pinned, table

MAGIC = b"DAC1"
HEADER = struct.Struct("<4sIQQQII")  # magic, task, tokens before in the task, documents, tokens, levels, shard
SHARD_TOKENS = 1_000_000
DIRECTORY_BYTES = 64
CACHE_ENTRIES = 120_000  # a worker keeps them as long as it lives, and idle workers live on
MARKS = frozenset(".,;:!?")
END_ID = 0


class Encoder:
    """Encodes texts by pieces that the tokenizer never merges across, each piece once.

    The byte-level pattern starts a new piece at a space or line feed that follows no white
    space. Texts where white space follows white space, or ends the text, and texts that hold an
    added token (as ``<|endoftext|>``) go to the library as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        size = self.library.get_vocab_size()
        self.sizes = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        added = [re.escape(x.content) for x in self.library.get_added_tokens_decoder().values() if x.content]
        self.irregular = re.compile(r"\s\s|\s\Z").search
        self.added = re.compile("|".join(added) or r"(?!)").search  # on its own: faster than as one more branch
        line_feed, *marks = self.whole(["\n", *MARKS])
        self.lead = len(line_feed)
        self.marks = dict(zip(MARKS, marks))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        units = [p if p[:1] == "\n" else " " + p for p in pieces]
        for at in range(0, len(units), 20_000):
            part = units[at : at + 20_000]
            ids = np.array(self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            made = np.cumsum(self.sizes[ids])
            ends = np.cumsum([len(u.encode()) for u in part])
            cuts = np.searchsorted(made, ends)
            if len(made) and cuts[-1] < len(made) and (made[cuts] == ends).all():
                cuts = (cuts + 1) * 4
                raw = ids.tobytes()
                found = [raw[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
            else:
                found = self.whole(part)
            self.cache.update(zip(pieces[at : at + 20_000], found))

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [None if self.irregular(s := "\n" + t) or self.added(s) else s.replace("\n", " \n").split(" ")[1:] for t in texts]
        unknown: set[str] = set()
        for x in pieces:
            unknown.update(x or ())
        unknown.difference_update(self.cache)
        # a mark behind a letter ends the piece before it, so most words with one need no encoding
        marked = [p for p in unknown if p[-1:] in MARKS and p[-2:-1].isalpha()]
        plain = [p for p in unknown if not (p[-1:] in MARKS and p[-2:-1].isalpha())]
        new = list(dict.fromkeys([*plain, *(s for p in marked if (s := p[:-1]) not in self.cache)]))
        self.learn(new)
        self.cache.update((p, self.cache[p[:-1]] + self.marks[p[-1]]) for p in marked)
        new += marked
        get = self.cache.__getitem__
        out = [b"".join(map(get, x))[self.lead :] if x else self.whole([t])[0] if t else b"" for x, t in zip(pieces, texts)]
        for p in new[max(0, CACHE_ENTRIES - len(self.cache) + len(new)) :]:
            self.cache.pop(p, None)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, whatever number of tasks it runs."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def coded(ids: np.ndarray) -> bytes:
    """The levels of an array of ids."""
    out, rest, levels = [], ids.astype(np.uint32), 0
    while levels == 0 or len(rest):
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.pad(np.bitwise_count(bits), (0, -len(bits) % DIRECTORY_BYTES)).reshape(-1, DIRECTORY_BYTES).sum(1, dtype=np.uint32)
        ranks = np.cumsum(blocks, dtype=np.uint32) - blocks
        out += [struct.pack("<Q", len(rest)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        levels += 1
    return b"".join(out)


def shard(task: int, before: int, number: int, doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids)
    levels = coded(flat)
    count = max(1, -(-int(flat.max()).bit_length() // 8)) if len(flat) else 1
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([
        HEADER.pack(MAGIC, task, before, len(doc_ids), len(flat), count, number),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls.tobytes(),
        np.cumsum([len(x) for x in ids]).astype("<u8").tobytes(), levels,
    ])


class Shard:
    """Reads a shard: documents, single tokens, or all ids."""

    def __init__(self, raw: bytes):
        magic, self.task, self.before, n, self.n_tokens, levels, self.number = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.nulls = np.frombuffer(raw, np.uint8, n, at + 8 * n)
        self.ends = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        self.levels = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", raw, at)
            at += 8
            n_bits = -(-size // 8)
            n_ranks = -(-n_bits // DIRECTORY_BYTES)
            self.levels.append((np.frombuffer(raw, np.uint8, size, at), np.frombuffer(raw, np.uint8, n_bits, at + size), np.frombuffer(raw, "<u4", n_ranks, at + size + n_bits)))
            at += size + n_bits + 4 * n_ranks

    def token(self, i: int) -> int:
        """The i-th id, by one step per level."""
        value = 0
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            first = byte // DIRECTORY_BYTES
            i = int(ranks[first]) + int(np.bitwise_count(bits[first * DIRECTORY_BYTES : byte]).sum()) + int(bits[byte] & ((1 << bit) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        above = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            here[np.unpackbits(bits, count=len(chunks), bitorder="little").view(bool)] |= above << np.uint32(8)
            above = here
        return above


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes the texts (null: empty), appends ``end_id`` to each, and writes shards in order of
    doc_id (null first, equal ids by text). An empty table writes no shard."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, number, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                piece = batch.slice(at, 1000)
                for name, raw in zip(piece.column("doc_id").to_pylist(), encoder(tokenizer_path).encode(piece.column("text").to_pylist())):
                    names.append(name)
                    ids.append(np.frombuffer(raw + end, "<u4"))
                    size += len(ids[-1])
                    if size >= shard_tokens:
                        yield pa.RecordBatch.from_arrays([pa.array([shard(task, before, number, names, ids)], pa.binary())], names=["shard"])
                        before, number, size, ids, names = before + size, number + 1, 0, [], []
        if names:
            yield pa.RecordBatch.from_arrays([pa.array([shard(task, before, number, names, ids)], pa.binary())], names=["shard"])

    shards = rows.mapInArrow(encode, "shard binary").select(F.col("shard").cast("string").alias("value"))
    shards.write.option("maxRecordsPerFile", 1).text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids (little-endian 32-bit)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content"):
                raw = raw.as_py()
                if not raw:
                    continue
                s = Shard(raw)
                ids, starts = s.ids().astype("<u4"), np.r_[0, s.ends[:-1]]
                for at in range(0, len(s.ends), 2000):
                    a, b = starts[at : at + 2000], s.ends[at : at + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s.doc_ids[at : at + 2000], mask=s.nulls[at : at + 2000].view(bool)), pa.array(np.full(len(a), s.task, np.int64)),
                         pa.array(a + s.before), pa.array(b - a), pa.array([ids[x:y].tobytes() for x, y in zip(a, b)], pa.binary())],
                        names=["doc_id", "task", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(decode, "doc_id long, task long, start long, n_tokens long, ids binary")


def with_global_start(rows: DataFrame) -> DataFrame:
    """Moves ``start`` from within the writing task to within all files: one total per task is summed up."""
    totals = rows.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "task").withColumn("start", F.col("start") + F.col("before")).drop("task", "before")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_work_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    rows = read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return with_global_start(pinned(rows, "token-index"))
