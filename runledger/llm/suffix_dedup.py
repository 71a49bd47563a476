"""Removal of byte strings of a fixed length that also start anywhere else, by sorted suffixes.

A string of ``size`` bytes is found by its anchor: the 16-byte piece with the least hash among
its first ones. Equal strings have equal anchors, so only suffixes at anchors are sorted, and of
these only those whose first bytes occur twice or more (one shuffle of packed hashes tells).

The suffixes are sorted as a distributed merge sort: a task sorts its suffixes into a run, cuts
the run at the splitters of all ranges, and front-codes each piece (bytes shared with the
suffix before, then the rest). The task of a range merges its pieces with a loser tree that
carries the common prefix of every loser with the winner: two suffixes are compared only behind
what both are known to share, and the common prefix with the suffix before comes for free.

In the sorted order the suffixes that share enough bytes are neighbours; within such a run the
bytes before the anchor are compared, for every number of them that a string may have. Suffixes
with equal surroundings are one, whatever their number; documents are looked up by a digest of
the surroundings afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, keyed, mixed, pinned, same_key, table, text_bytes
from .repeats import repeated_places

SIZE = 400
PIECE = 16
LEAD = 113  # pieces among which a string's anchor is chosen
RUN = 40_000
PER_RANGE = 30_000
SAMPLE_TEXTS = 2000
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def piece_hashes(data: np.ndarray) -> np.ndarray:
    h = data.astype(U64) + U64(1)
    for k, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9), (8, 0xD6E8FEB86659FD93)):
        h = h[:-k] * U64(factor) + h[k:]
    return mixed(h)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i; those that reach beyond the end miss values."""
    n = len(x)
    padded = np.full(-(-n // width) * width + width, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Of all anchors: number of the text, place, first and last start of the strings they are
    the anchor of (places in the text), and the hash of the bytes that all those share."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(n) - n
    counts = np.maximum(n - size + 1, 0)
    none = np.zeros(0, np.int64)
    if not counts.sum():
        return none, none, none, none, np.zeros(0, U64)
    h = piece_hashes(data)
    at = (sliding_minimum((h >> U64(32) << U64(32)) | np.arange(len(h), dtype=U64), LEAD) & U64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = at[first[owner] + start]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(owner)] - 1
    shared = np.zeros(len(new), U64)
    for k in range((size - LEAD + 1) // PIECE):
        shared = shared * U64(0x9E3779B97F4A7C15) + h[place[new] + k * PIECE]
    return owner[new], place[new] - first[owner[new]], start[new], start[last], mixed(shared)


def anchors_of(size: int):
    def hasher(texts: list[bytes]):
        owner, place, _, _, shared = anchors(texts, size)
        return shared, place, np.bincount(owner, minlength=len(texts))

    return hasher


def head(suffix: bytes) -> int:
    return int.from_bytes(suffix[:8], "big")


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, ``known`` bytes of which need no look."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


Entry = tuple[bytes, bytes, int, int, bytes]  # suffix, bytes before it, fewest of them in a string, occurrences (1, or 2 for more), digest


def front_coded(run: list[Entry]) -> bytes:
    """A sorted run: 16-bit numbers by column, then tails, bytes before, digests."""
    suffixes = [e[0] for e in run]
    common = [0] + [shared_prefix(a, b, 0) for a, b in zip(suffixes, suffixes[1:])]
    numbers = np.array([common, [len(s) - c for s, c in zip(suffixes, common)], [len(e[1]) for e in run], [e[2] for e in run], [e[3] for e in run]], "<u2")
    return b"".join([len(run).to_bytes(4, "little"), numbers.tobytes(), *(s[c:] for s, c in zip(suffixes, common)), *(e[1] for e in run), *(e[4] for e in run)])


def decoded(raw: bytes) -> Iterator[tuple[int, Entry]]:
    """Entries of a run with the common prefix with the one before."""
    n = int.from_bytes(raw[:4], "little")
    common, tails, lefts, least, many = np.frombuffer(raw, "<u2", 5 * n, 4).reshape(5, n).tolist()
    at = 4 + 10 * n
    left_at = at + sum(tails)
    digest_at = left_at + sum(lefts)
    suffix = b""
    for c, t, b, m, k in zip(common, tails, lefts, least, many):
        suffix = suffix[:c] + raw[at : at + t]
        yield c, (suffix, raw[left_at : left_at + b], m, k, raw[digest_at : digest_at + 16])
        at, left_at, digest_at = at + t, left_at + b, digest_at + 16


class LoserTree:
    """Merges sorted runs; gives entries with the common prefix with the entry given before."""

    def __init__(self, runs: list[Iterator[tuple[int, Entry]]]):
        self.runs = runs
        self.heads: list[tuple[int, Entry] | None] = [next(r, None) for r in runs]
        self.known = [0] * len(runs)  # of each head with the winner it lost to, or the entry given before
        self.size = len(runs)
        self.losers = [-1] * self.size
        self.winner = self.play(1) if self.size > 1 else 0

    def play(self, node: int) -> int:
        """Winner below a node; leaves are the nodes from ``size`` on."""
        if node >= self.size:
            return node - self.size
        return self.meet(node, self.play(2 * node), self.play(2 * node + 1))

    def meet(self, node: int, a: int, b: int) -> int:
        """Keeps the loser of a and b at the node, gives the winner."""
        heads, known = self.heads, self.known
        if heads[a] is None or heads[b] is None:
            win, lose = (b, a) if heads[a] is None else (a, b)
        elif known[a] != known[b]:
            win, lose = (a, b) if known[a] > known[b] else (b, a)
        else:
            x, y = heads[a][1][0], heads[b][1][0]
            c = shared_prefix(x, y, known[a])
            win, lose = (a, b) if x[c : c + 1] < y[c : c + 1] or (x[c : c + 1] == y[c : c + 1] and a < b) else (b, a)
            known[lose] = c
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        while (top := self.heads[self.winner]) is not None:
            w = self.winner
            yield self.known[w], top[1]
            self.heads[w] = after = next(self.runs[w], None)
            self.known[w] = after[0] if after else 0
            node = (w + self.size) // 2
            while node:
                w = self.meet(node, w, self.losers[node])
                node //= 2
            self.winner = w


def repeated_starts(entries: list[Entry], common: np.ndarray, size: int) -> Iterator[tuple[bytes, bytes]]:
    """Digest and ranges of starts (from the first of the surroundings) of the strings that occur
    twice or more. ``entries`` are sorted, ``common`` their shared prefixes with the one before."""
    n = len(entries)
    lead = np.array([len(e[1]) for e in entries])
    least = np.array([e[2] for e in entries])
    weight = np.array([e[3] for e in entries])
    width = int(lead.max()) if n else 0
    before = np.zeros((n, width + 1), U64)
    for i, e in enumerate(entries):
        before[i, : lead[i]] = np.frombuffer(e[1], np.uint8)[::-1]
    hashes = np.zeros(n, U64)
    hit = np.zeros((n, width + 1), bool)
    for k in range(width + 1):
        here = np.flatnonzero((least <= k) & (k <= lead))
        if len(here):
            group = np.cumsum(common < size - k).astype(U64)
            key = mixed(hashes[here] ^ mixed(group[here]))
            _, where = np.unique(key, return_inverse=True)
            hit[here, k] = np.bincount(where, weight[here])[where] > 1
        hashes = (hashes + before[:, k] + U64(1)) * U64(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(hit.any(1)).tolist():
        mask = hit[i, : lead[i] + 1][::-1]
        edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
        yield entries[i][4], edges.astype("<u2").tobytes()


def merged(pieces: list[bytes], size: int) -> Iterator[tuple[bytes, bytes]]:
    """Merges the runs of one range; looks at the suffixes in groups that share enough bytes.

    Equal surroundings of several runs become one entry: one row per digest leaves the range,
    however many runs brought it.
    """
    held: list[Entry] = []
    common: list[int] = []
    group: list[Entry] = []
    shares: list[int] = []
    known: dict[bytes, int] = {}  # digest to place in the group
    passed = size  # least prefix shared on the way over entries left out

    def close() -> None:
        if len(group) > 1 or group and group[0][3] > 1:
            held.extend(group)
            common.extend([0, *shares[1:]])
        group.clear()
        shares.clear()
        known.clear()

    for c, entry in LoserTree([decoded(p) for p in pieces]):
        if (at := known.get(entry[4])) is not None:
            suffix, before, least, _, digest = group[at]
            group[at] = suffix, before, least, 2, digest
            passed = min(passed, c)
            continue
        c, passed = min(c, passed), size
        if c < size - LEAD + 1:
            close()
            if len(held) >= RUN:
                yield from repeated_starts(held, np.array(common), size)
                held.clear()
                common.clear()
        known[entry[4]] = len(group)
        group.append(entry)
        shares.append(c)
    close()
    if held:
        yield from repeated_starts(held, np.array(common), size)


def repeated_ranges(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, parts: (first, ranges): starts first + ranges of repeated strings."""
    n_texts, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    found = pinned(repeated_places(rows, anchors_of(size), n_bytes // 50), "anchors", free=True)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                texts = text_bytes(batch.column("text").slice(at, 250))
                owner, place, *_ = anchors(texts, size)
                found = [head(texts[o][p : p + 8]) >> 1 for o, p in zip(owner.tolist(), place.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["head"])

    n_anchors = found.agg(F.coalesce(F.sum(F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p))), F.lit(0))).first()[0] // 4
    ranges = max(1, -(-n_anchors // PER_RANGE))
    sample = rows.select("text").sample(min(1.0, SAMPLE_TEXTS / max(n_texts, 1)), seed=1).mapInArrow(heads, "head long")
    cuts = sample.agg(F.percentile("head", F.array(*[F.lit((i + 1) / ranges) for i in range(ranges - 1)])) if ranges > 1 else F.lit(None)).first()[0] if ranges > 1 else None
    splitters = np.unique(np.array(cuts or [], np.float64).astype(np.int64))

    columns = [("range", pa.int64()), ("run", pa.binary()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("text_hash", pa.int32()), ("first", pa.int64())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def table_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), columns)], names=[n for n, _ in columns])

        def runs() -> pa.RecordBatch:
            entries = sorted(map(tuple, held.values()))
            held.clear()
            ends = np.searchsorted(splitters, np.array([head(e[0]) >> 1 for e in entries], np.int64), "right")
            starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]).tolist()
            return table_of([(int(ends[a]), front_coded(entries[a:b]), None, None, None, None) for a, b in zip(starts, [*starts[1:], len(entries)])])

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                piece = batch.slice(at, 200)
                texts = text_bytes(piece.column("text"))
                wanted = [np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in ps])) for ps in piece.column("places").to_pylist()]
                ids, hashes = piece.column("doc_id").to_pylist(), piece.column("text_hash").to_pylist()
                owner, place, first, last, _ = anchors(texts, size)
                refs = []
                for o, p, a, b in zip(owner.tolist(), place.tolist(), first.tolist(), last.tolist()):
                    w = wanted[o]
                    i = int(np.searchsorted(w, p))
                    if i == len(w) or w[i] != p:
                        continue
                    text = texts[o]
                    before, suffix = text[a:p], text[p : b + size]
                    digest = hashlib.blake2b(before + suffix, digest_size=16, salt=len(before).to_bytes(8, "little")).digest()
                    if digest in held:
                        held[digest][3] = 2
                    else:
                        held[digest] = [suffix, before, p - b, 1, digest]
                    refs.append((None, None, digest, ids[o], hashes[o], a))
                if refs:
                    yield table_of(refs)
                if len(held) >= RUN:
                    yield runs()
        if held:
            yield runs()

    joined = rows.join(found, same_key(rows, found)).select(rows["doc_id"], rows["text_hash"], rows["text"], found["places"])
    told = pinned(joined.mapInArrow(cut, "range long, run binary, digest binary, doc_id long, text_hash int, first long"), "suffix-runs", free=True)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(merged(list(group.run), size)), columns=["digest", "ranges"])

    runs = told.where("run IS NOT NULL").select("range", "run").repartition(max(ranges, 1), "range")
    starts = pinned(runs.groupBy("range").applyInPandas(merge, "digest binary, ranges binary"), "suffix-starts", free=True)
    refs = told.where("digest IS NOT NULL").select("digest", "doc_id", "text_hash", "first")
    return refs.join(starts, "digest").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "ranges")).alias("parts"))


def suffix_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, spans (maximal removed runs of
    bytes, end exclusive), kept (the other bytes).

    Null texts are empty; texts shorter than ``size`` bytes lose nothing. Rows with equal id and
    text count as two occurrences, like any copies. An empty table gives no rows; other columns
    than doc_id and text are not read.
    """
    rows = keyed(docs)
    found = repeated_ranges(rows, size)
    joined = rows.join(found, same_key(rows, found), "left").select(rows["doc_id"], rows["text"], found["parts"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(text_bytes(batch.column("text")), batch.column("parts").to_pylist()):
                if not parts:
                    out.append((len(text), 0, [], text))
                    continue
                steps = np.zeros(len(text) + 1, np.int64)
                for p in parts:
                    edges = np.frombuffer(p["ranges"], "<u2").astype(np.int64) + p["first"]
                    np.add.at(steps, edges[::2], 1)
                    np.add.at(steps, edges[1::2] - 1 + size, -1)
                mask = np.cumsum(steps[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0])).tolist()
                spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]
                out.append((len(text), int(mask.sum()), spans, np.frombuffer(text, np.uint8)[~mask].tobytes()))
            n, gone, spans, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
