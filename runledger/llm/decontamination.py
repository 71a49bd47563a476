"""Benchmark decontamination by edit distance over item-sized windows of words.

An item of n words, u of them distinct, matches where a run of words lies within d edits of it.
Such a run has n - d to n + d words and holds at least u - d of the item's distinct words, so
each start of a text is tried with a window of n + d words and the edit distance is taken over
all ends of the window. Longer items are cut into pieces: if each piece had more than its share
of edits, so had the item, so some piece is found, and the item is verified around it. Pieces of
similar length share a band, searched in one pass over the words.

Windows that hold enough of a piece's words and the pieces are embedded by random walks that map
edit distance to Hamming distance: step j emits the current word and moves on if a random bit of
(j, word) says so. Tables of a few sampled steps bring windows and items together; the number of
tables follows from the chance that a random edit of d words still agrees in one of them,
measured on the pieces themselves (edits of one kind or mixed), and the recall asked for. Pieces
that would need many tables get tables of fewer steps; there is no bound on their number. Matches are confirmed by exact
edit distance.

The items are a query set: they are taken in blocks of bounded size, all documents against
each block, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, ranges, table, text_bytes

SHARE = 0.2
RECALL = 0.999
STEPS_PER_TABLE = 5
TABLES_PER_WALK = 4
FEW_TABLES = 48  # beyond it, tables of fewer steps are taken
BAND = 1.25  # longest to shortest piece of a band
PIECE = 64  # words
BLOCK_ITEMS = 5000
BLOCK_WORDS = 500_000
CELLS = 2_000_000  # of a matrix of windows
TRIALS = 50
TRIAL_WALKS = 16
OUT = -1


def distances(words: list, masks: dict, n: int, anywhere: bool = False) -> Iterator[int]:
    """For each end in ``words``, the edit distance of what lies before it to an item of n words,
    given by its bit masks (bit-parallel). ``anywhere``: from the best start, else from the first word."""
    ones, step = (1 << n) - 1, 0 if anywhere else 1
    up, down, score, top = ones, 0, n, 1 << (n - 1)
    for w in words:
        eq = masks.get(w, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & ones
        plus = down | (~(d0 | up) & ones)
        minus = up & d0
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        yield score
        plus = (plus << 1 | step) & ones
        minus = (minus << 1) & ones
        up = minus | (~(d0 | plus) & ones)
        down = plus & d0


def edit_distance(words: list, masks: dict, n: int) -> int:
    score = n
    for score in distances(words, masks, n):
        pass
    return score


def nearest_prefix(words: list, masks: dict, n: int) -> tuple[int, int]:
    """(distance, length) of the prefix nearest to the item, the shortest of equal ones."""
    return min(((d, k) for k, d in enumerate(distances(words, masks, n), 1)), default=(n, 0))


def best_run(words: list, item: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the run of words nearest to the item, the first of equal ones."""
    n = len(item)
    least = min(distances(words, masks_of(item), n, True), default=n)
    if least > most:
        return None
    back = distances(words[::-1], masks_of(item[::-1]), n, True)
    start = len(words) - max(k for k, d in enumerate(back, 1) if d == least)
    return least, start, start + nearest_prefix(words[start:], masks_of(item), n)[1]


def masks_of(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def embedded(flat: np.ndarray, start: np.ndarray, size: np.ndarray, coins: np.ndarray) -> np.ndarray:
    """Random-walk embeddings of the runs of symbols ``flat[start : start + size]``: one row each."""
    at = np.zeros(len(start), np.int64)
    out = np.full((len(start), len(coins)), OUT - 1, np.int64)
    for j, coin in enumerate(coins):
        inside = at < size
        symbol = flat[np.where(inside, start + at, 0)]
        out[inside, j] = symbol[inside]
        at += inside & (((symbol.astype(np.uint64) + np.uint64(7)) * coin >> np.uint64(63)) == 1)
    return out


def regions(places: list[int], most: int, n: int) -> Iterator[tuple[int, int]]:
    """What an item of n words can cover if it starts within ``most`` words of one of ``places``;
    starts that lie close together are one region."""
    first = last = places[0]
    for at in places[1:]:
        if at > last + 2 * most + 1:
            yield first - most, last + n + 2 * most
            first = at
        last = at
    yield first - most, last + n + 2 * most


class Band:
    """Pieces of similar length, given as (item, offset in it, words), with their tables."""

    def __init__(self, items: list[tuple[int, int, list[int]]], vocabulary: int, share: float, recall: float):
        self.item = [item for item, _, _ in items]
        self.offset = [offset for _, offset, _ in items]
        self.words = [np.array(w, np.int64) for _, _, w in items]
        self.size = np.array([len(w) for w in self.words])
        self.edits = (share * self.size).astype(np.int64)
        self.width = int((self.size + self.edits).max())
        self.shortest = int((self.size - self.edits).min())
        distinct = [np.unique(w) for w in self.words]
        self.least = np.maximum(np.array([len(w) for w in distinct]) - self.edits, 1)
        # items that hold word w: posted[starts[w] : starts[w + 1]]; the last word is that of no item
        word, item = np.concatenate(distinct), np.repeat(np.arange(len(items)), [len(w) for w in distinct])
        self.posted = item[np.argsort(word, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=vocabulary + 1))])
        # past these steps, a walk may leave a short piece
        self.steps = max(STEPS_PER_TABLE, int(1.6 * self.size.min()))
        rng = np.random.default_rng(int(self.size.min()))
        self.per_table, tables = self.plan(rng, vocabulary, recall)
        self.walks = [self.walk(rng, self.per_table) for _ in range(-(-tables // TABLES_PER_WALK))]
        flat, start = np.concatenate(self.words), np.cumsum(self.size) - self.size
        self.tables = []
        for coins, steps in self.walks:
            full = embedded(flat, start, self.size, coins)
            self.tables.append([self.sorted_keys(full[:, s]) for s in steps])

    def walk(self, rng, per_table: int) -> tuple[np.ndarray, list[np.ndarray]]:
        coins = rng.integers(0, 1 << 63, self.steps).astype(np.uint64) | np.uint64(1)
        return coins, [np.sort(rng.choice(self.steps, per_table, replace=False)) for _ in range(TABLES_PER_WALK)]

    def plan(self, rng, vocabulary: int, recall: float) -> tuple[int, int]:
        """Steps of a table and number of tables that reach the recall in trials: items against
        themselves with all edits allowed and other words behind."""
        runs: list[list[int]] = []
        for trial in range(TRIALS):
            pick = int(rng.integers(len(self.words)))
            a = self.words[pick].tolist()
            b = list(a)
            for kind in rng.integers(0, 3, self.edits[pick]) if trial % 4 == 3 else [trial % 4] * self.edits[pick]:
                at = int(rng.integers(0, len(b) + 1))
                b[at : at + (kind != 0)] = [int(rng.integers(vocabulary))] if kind != 2 else []
            runs += [a, (b + rng.integers(0, vocabulary, self.width).tolist())[: self.width]]
        size = np.array([len(x) for x in runs])
        flat, start = np.array([w for x in runs for w in x], np.int64), np.cumsum(size) - size
        agree = []
        for _ in range(TRIAL_WALKS):
            both = embedded(flat, start, size, self.walk(rng, 1)[0])
            agree.append(both[::2] == both[1::2])
        found = []
        for per_table in range(STEPS_PER_TABLE, 0, -1):
            hits = sum(one[:, s].all(1).astype(int) for one in agree for s in self.walk(rng, per_table)[1])
            missed = 1 - (hits + 0.5) / (TRIAL_WALKS * TABLES_PER_WALK + 1)
            tables = 1
            while (missed**tables).mean() > 1 - recall:
                tables += 1
            if tables <= FEW_TABLES:
                return per_table, tables
            found.append((tables, per_table))
        tables, per_table = min(found)
        return per_table, tables

    @staticmethod
    def keys(rows: np.ndarray) -> np.ndarray:
        key = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            key = (key ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def sorted_keys(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.keys(rows)
        order = np.argsort(key, kind="stable")
        return key[order], order

    def near(self, flat: np.ndarray, before: np.ndarray, first: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of windows that hold enough distinct words of some item. ``before``: place
        of the same word before, ``first`` and ``ends``: of the text, for each place."""
        many = np.diff(self.starts)
        at = np.flatnonzero(many[flat])
        lo = np.maximum(np.maximum(before[at], at - self.width), first[at] - 1) + 1
        distinct = np.cumsum(np.bincount(lo, minlength=len(flat) + 1) - np.bincount(at + 1, minlength=len(flat) + 1))[:-1]
        start = np.flatnonzero(distinct >= self.least.min())
        end = np.minimum(start + self.width, ends[start])
        fits = end - start >= self.shortest
        start, end = start[fits], end[fits]
        good = np.zeros(len(start), bool)
        rows = max(1, CELLS // max(self.width, len(self.item)))
        for k in range(0, len(start), rows):
            place = start[k : k + rows, None] + np.arange(self.width)
            inside = place < end[k : k + rows, None]
            place = np.minimum(place, len(flat) - 1)
            window, column = np.nonzero(inside & (before[place] < start[k : k + rows, None]) & (many[flat[place]] > 0))
            word = flat[place[window, column]]
            item = self.posted[np.repeat(self.starts[word], many[word]) + ranges(many[word])]
            held = np.bincount(np.repeat(window, many[word]) * len(self.item) + item, minlength=len(place) * len(self.item))
            good[k : k + rows] = (held.reshape(len(place), -1) >= self.least).any(1)
        return start[good], end[good]

    def candidates(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a table."""
        found = []
        for (coins, steps), tables in zip(self.walks, self.tables):
            full = embedded(flat, start, size, coins)
            for s, (keys, order) in zip(steps, tables):
                key = self.keys(full[:, s])
                lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                window = np.repeat(np.arange(len(key)), hi - lo)
                offset = np.arange(len(window)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                found.append(window * len(self.item) + order[np.repeat(lo, hi - lo) + offset])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.item), pairs % len(self.item)


class Index:
    """A block of items, ready to be searched in texts."""

    def __init__(self, items: list[tuple[int | None, bytes]], share: float = SHARE, recall: float = RECALL):
        words = [(name, text.lower().split()) for name, text in items]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for _, ws in words for w in ws))}
        self.items = [(name, [self.ids[w] for w in ws]) for name, ws in words]
        self.share = share
        pieces = []
        for i, (_, ws) in enumerate(self.items):
            cuts = -(-len(ws) // PIECE)
            borders = [len(ws) * k // cuts for k in range(cuts + 1)] if cuts else []
            pieces += [(i, a, ws[a:b]) for a, b in zip(borders, borders[1:])]
        bands: list[list] = []
        for piece in sorted(pieces, key=lambda x: len(x[2])):
            if not bands or len(piece[2]) > BAND * len(bands[-1][0][2]):
                bands.append([])
            bands[-1].append(piece)
        self.bands = [Band(held, len(self.ids), share, recall) for held in bands]

    def matches(self, texts: list[bytes]) -> dict[int, list[tuple]]:
        """By number of the text: (item, start word, end word, edits), the best window of each item."""
        words = [t.lower().split() for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        get = self.ids.get
        flat = np.fromiter((get(x, OUT) for w in words for x in w), np.int64, int(sizes.sum()))
        first = np.cumsum(sizes) - sizes
        starts: dict[tuple[int, int], set] = {}  # by text and item: where the item may start
        order = np.argsort(flat, kind="stable")
        before = np.full(len(flat), OUT, np.int64)
        same = flat[order][1:] == flat[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        of = np.repeat(np.arange(len(texts)), sizes)
        for band in self.bands:
            if not len(flat):
                break
            near, end = band.near(flat, before, first[of], (first + sizes)[of])
            doc = of[near]
            rows = max(1, CELLS // band.steps)
            for at in range(0, len(near), rows):
                part = slice(at, at + rows)
                window, item = band.candidates(flat, near[part], (end - near)[part])
                for w, i in zip((window + at).tolist(), item.tolist()):
                    starts.setdefault((int(doc[w]), band.item[i]), set()).add(int(near[w]) - band.offset[i])
        best: dict[int, dict] = {}
        for (d, i), places in starts.items():
            name, item = self.items[i]
            most, low, high = int(self.share * len(item)), int(first[d]), int(first[d] + sizes[d])
            for a, b in regions(sorted(places), most, len(item)):
                a = max(a, low)
                found = best_run(flat[a : min(b, high)].tolist(), item, most)
                if found:
                    run = (found[0], found[1] + a - low, found[2] + a - low)
                    held = best.setdefault(d, {})
                    held[name] = min(held.get(name, run), run)
        return {d: [(name, s, e, k) for name, (k, s, e) in sorted(m.items(), key=lambda x: (x[0] is None, x[0] or 0))] for d, m in best.items()}


def blocks(benchmark: DataFrame, share: float, recall: float) -> Iterator[Index]:
    """Items in blocks; texts without words match nothing."""
    held: list[tuple[int | None, bytes]] = []
    words = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        held.append((row[0], row[1].encode()))
        words += len(held[-1][1].split())
        if len(held) >= BLOCK_ITEMS or words >= BLOCK_WORDS:
            yield Index(held, share, recall)
            held, words = [], 0
    if held:
        yield Index(held, share, recall)


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, start, end, edits), words of the document's best run for each item
    within ``share`` times the item's words of edits: least edits, then first start, then first end.

    Null and empty texts match nothing; repeated rows match repeatedly; items that share an id
    count as one, so do those without one. No rows without documents or items. Other columns are not read.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, edits long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = []
    for index in blocks(benchmark, share, recall):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    piece = batch.slice(at, 2000)
                    found = shared.value.matches(text_bytes(piece.column("text")))
                    flat = [(d, *m) for d, ms in sorted(found.items()) for m in ms]
                    if flat:
                        d, *columns = zip(*flat)
                        yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(d)), *(pa.array(c, pa.int64()) for c in columns)],
                                                         names=["doc_id", "item_id", "start", "end", "edits"])

        parts.append(rows.mapInArrow(search, schema))
    if len(parts) > 1:
        parts = [pinned(p, "matches") for p in parts]
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = p if p is parts[0] else out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without a match, all columns as they are, in one pass per block."""
    for index in blocks(benchmark, share, recall):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    piece = batch.slice(at, 2000)
                    found = shared.value.matches(text_bytes(piece.column("text").fill_null("")))
                    yield piece.filter(pa.array([i not in found for i in range(piece.num_rows)], pa.bool_())) if found else piece

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
