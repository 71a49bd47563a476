"""Vector codes: parts of vectors assigned to codebook entries through metric trees.

A vector of integers is cut into equal parts; each part position has a codebook, refined by a few
rounds of assigning every part to its nearest entry and replacing the entries by means. Each task
builds, once, a tree of balls over the parts of a bounded number of vectors, middle out: the parts of a
position are first gathered around anchors (each new anchor is the part farthest from its own, and
takes over whatever is closer to it; by the triangle inequality only parts farther from their
anchor than half the distance of the anchors can change); anchors are then merged pairwise up to a
root, and split down into small leaves in the same way. A ball holds pivot, radius, and the sum and
number of its parts.

A round walks down from the roots with a list of the entries that can still be nearest to
something in the ball. What is farther than another entry everywhere in the ball leaves the list,
and the list is handed down. A ball with one entry left is wholly owned: its cached sum and number
go to the entry without a look at its parts. In leaves that are still disputed, parts are compared
with the entries left, in exact integers.

The trees are a written table, one row per tree; the rounds read it, add up sums per
entry on Spark, and bring the codebooks alone (parts x entries rows) to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pinned, ranges, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: an integer beyond this (|x| of 16 384) is no component that can be coded: all sums of squares are exact below it
MOST = 1 << 22
#: components of the vectors that share a tree, point-entry pairs compared at once, points of a leaf
CHUNK = 1 << 18
COMPARED = 1 << 17
LEAF = 24


class Tree(NamedTuple):
    """Balls over points of all positions, one root per position first; the children of ball i are ``child[i]`` to ``child[i] + number[i] - 1``
    (a leaf has none); ``first`` and ``last`` bound a ball's points in ``order``, the point numbers."""

    position: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    number: np.ndarray
    order: np.ndarray


def anchored(points: np.ndarray, group: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Anchors for every group of points, ``number[g]`` of them at most: each point's anchor, as a point number.

    All groups get their next anchor in the same step. ``group``: group of each point, ascending.
    """
    starts = np.searchsorted(group, np.arange(len(number)))
    most = int(number.max(initial=1))
    anchors = np.repeat(starts[:, None], most, axis=1)
    own = np.zeros(len(points), np.int64)
    away = np.sqrt(((points - points[starts[group]]) ** 2).sum(axis=1))
    for step in range(1, most):
        farthest = np.maximum.reduceat(away, starts)
        grows = (number > step) & (farthest > 0)
        if not grows.any():
            break
        at_most = np.nonzero(away == farthest[group])[0]
        anchors[group[at_most], step] = at_most
        new = points[anchors[:, step]]
        # a point nearer to its anchor than half the way to the new one cannot change hands
        half = np.sqrt(((points[anchors[:, :step]] - new[:, None]) ** 2).sum(axis=2)) / 2
        half[~grows] = np.inf
        open_ = np.nonzero(away >= half[group, own])[0]
        to_new = np.sqrt(((points[open_] - new[group[open_]]) ** 2).sum(axis=1))
        taken = to_new < away[open_]
        own[open_[taken]] = step
        away[open_[taken]] = to_new[taken]
    return anchors[group, own]


def merged(pivot: np.ndarray, radius: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to be merged, in order; the n-th pair becomes ball len(pivot) + n. The pair that fits into the
    smallest ball goes first."""
    n = len(pivot)
    pivots, radii, weights = [*pivot], [*radius], [*weight]
    cost = np.full((2 * n, 2 * n), np.inf)
    way = np.sqrt(((pivot[:, None] - pivot[None]) ** 2).sum(axis=2))
    cost[:n, :n] = np.maximum((way + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
    cost[np.arange(n), np.arange(n)] = np.inf
    pairs, alive = [], np.zeros(2 * n, bool)
    alive[:n] = True
    for made in range(n, 2 * n - 1):
        a, b = divmod(int(cost[:made, :made].argmin()), made)
        pairs.append((a, b))
        w = weights[a] + weights[b]
        p = (pivots[a] * weights[a] + pivots[b] * weights[b]) / w
        r = max(np.sqrt(((p - pivots[x]) ** 2).sum()) + radii[x] for x in (a, b))
        cost[[a, b]] = cost[:, [a, b]] = np.inf
        alive[[a, b]] = False
        others = np.nonzero(alive[:made])[0]
        if len(others):
            ways = np.sqrt(((np.array([pivots[i] for i in others]) - p) ** 2).sum(axis=1))
            their = np.array([radii[i] for i in others])
            cost[made, others] = cost[others, made] = np.maximum((ways + their + r) / 2, np.maximum(their, r))
        pivots.append(p)
        radii.append(r)
        weights.append(w)
        alive[made] = True
    return pairs


def built(values: np.ndarray, leaf: int = LEAF) -> Tree:
    """The balls over ``values`` (positions x vectors x components, integers)."""
    positions, vectors, size = values.shape
    points = values.reshape(-1, size).astype(np.float64)
    # middle: anchors of every position
    order = np.arange(len(points))
    group = np.repeat(np.arange(positions), vectors)
    owner = anchored(points, group, np.full(positions, max(1, int(np.sqrt(vectors)))))
    order = np.argsort(group * len(points) + owner, kind="stable")
    marks = (group * len(points) + owner)[order]
    first = np.concatenate([[0], np.nonzero(np.diff(marks))[0] + 1])
    last = np.append(first[1:], len(order))
    place = group[order][first]

    # up: pairwise merging; each pair's points become neighbours in the order
    rows: list[tuple[int, list[int]]] = []  # position, children (as row numbers)
    roots: list[int] = []
    spans: list[tuple[int, int]] = []
    middle = []
    sums = np.add.reduceat(points[order], first, axis=0)
    centre = sums / (last - first)[:, None]
    reach = np.maximum.reduceat(np.sqrt(((points[order] - np.repeat(centre, last - first, axis=0)) ** 2).sum(axis=1)), first)
    new_order, at = [], 0
    for p in range(positions):
        balls = np.nonzero(place == p)[0]
        pairs = merged(centre[balls], reach[balls], (last - first)[balls])
        n = len(balls)

        def laid(node: int) -> int:
            """Lays out a node and what is below it, and gives its row."""
            nonlocal at
            row = len(rows)
            rows.append((p, []))
            spans.append((at, at))
            if node < n:
                b = balls[node]
                new_order.append(order[first[b] : last[b]])
                spans[row] = (at, at := at + int(last[b] - first[b]))
                middle.append(row)
            else:
                begin = at
                rows[row][1].extend(laid(x) for x in pairs[node - n])
                spans[row] = (begin, at)
            return row

        roots.append(len(rows))
        laid(n + len(pairs) - 1)
    order = np.concatenate(new_order)

    # down: balls above the leaf size are split by anchors of their own, all at once per level
    level = [r for r in middle if spans[r][1] - spans[r][0] > leaf]
    while level:
        span = np.array([spans[r] for r in level])
        count = span[:, 1] - span[:, 0]
        inside = np.repeat(span[:, 0], count) + ranges(count)
        group = np.repeat(np.arange(len(level)), count)
        own = anchored(points[order[inside]], group, np.maximum(2, np.sqrt(count).astype(int)))
        by = np.lexsort((own, group))
        order[inside] = order[inside[by]]
        own = own[by]
        cut = np.concatenate([[0], np.nonzero(np.diff(own) | np.diff(group))[0] + 1])
        ends = np.append(cut[1:], len(own))
        deeper = []
        for b, e in zip(cut.tolist(), ends.tolist()):
            of = int(group[b])
            if e - b == count[of]:
                continue  # all points are equal
            rows[level[of]][1].append(len(rows))
            rows.append((rows[level[of]][0], []))
            begin = int(inside[b])
            spans.append((begin, begin + e - b))
            if e - b > leaf:
                deeper.append(len(rows) - 1)
        level = deeper

    # rows in breadth-first order, so that children are neighbours
    queue, sorted_rows, child, number = roots, [], [], []
    while queue:
        base = len(sorted_rows) + len(queue)
        sorted_rows += queue
        below: list[int] = []
        for r in queue:
            child.append(base + len(below))
            number.append(len(rows[r][1]))
            below += rows[r][1]
        queue = below
    span = np.array([spans[r] for r in sorted_rows])
    count = span[:, 1] - span[:, 0]
    sums = np.vstack([np.zeros((1, size), np.int64), np.cumsum(values.reshape(-1, size)[order], axis=0)])
    total = sums[span[:, 1]] - sums[span[:, 0]]
    pivot = total / count[:, None]
    inside = np.repeat(span[:, 0], count) + ranges(count)
    gaps = np.sqrt(((points[order[inside]] - np.repeat(pivot, count, axis=0)) ** 2).sum(axis=1))
    radius = np.maximum.reduceat(gaps, np.cumsum(count) - count)
    return Tree(np.array([rows[r][0] for r in sorted_rows]), pivot, radius, total, span[:, 0], span[:, 1], np.array(child), np.array(number), order)


class Walk(NamedTuple):
    """``balls`` are wholly owned by ``entries``; the points (numbers) ``loose`` have the entries ``of_loose``."""

    balls: np.ndarray
    entries: np.ndarray
    loose: np.ndarray
    of_loose: np.ndarray


def walked(tree: Tree, values: np.ndarray, books: np.ndarray) -> Walk:
    """Hands lists of entries down the tree. ``books``: positions x entries x components."""
    positions, entries, size = books.shape
    points = values.reshape(-1, size)
    books_f = books.astype(np.float64)
    # an entry equal to a lower one is never the nearest
    new = np.array([np.isin(np.arange(entries), np.unique(b, axis=0, return_index=True)[1]) for b in books])
    ball, entry = np.nonzero(new)
    owned, owners, loose, of_loose = [], [], [], []
    while len(ball):
        starts = np.concatenate([[0], np.nonzero(np.diff(ball))[0] + 1])
        sizes = np.diff(np.append(starts, len(ball)))
        book = books_f[tree.position[ball], entry]
        far = ((tree.pivot[ball] - book) ** 2).sum(axis=1)
        least = np.repeat(np.minimum.reduceat(far, starts), sizes)
        best = np.full(len(starts), len(ball))
        hit = np.nonzero(far == least)[0]
        np.minimum.at(best, np.repeat(np.arange(len(starts)), sizes)[hit], hit)
        apart = np.sqrt(((book - np.repeat(book[best], sizes, axis=0)) ** 2).sum(axis=1))
        reach = tree.radius[ball]
        # by how much an entry is farther than the best one, wherever in the ball; rounding is far below the slack
        slack = 1e-6 * (far + least + reach * reach + 1)
        stays = far - least <= 2 * reach * apart + slack
        ball, entry = ball[stays], entry[stays]
        starts = np.concatenate([[0], np.nonzero(np.diff(ball))[0] + 1])
        sizes = np.diff(np.append(starts, len(ball)))
        alone = np.repeat(sizes == 1, sizes)
        owned.append(ball[alone])
        owners.append(entry[alone])
        ball, entry = ball[~alone], entry[~alone]
        at_leaf = tree.number[ball] == 0
        if at_leaf.any():
            found = compared(tree, points, books, ball[at_leaf], entry[at_leaf])
            loose.append(found[0])
            of_loose.append(found[1])
        ball, entry = ball[~at_leaf], entry[~at_leaf]
        below = tree.number[ball]
        ball, entry = np.repeat(tree.child[ball], below) + ranges(below), np.repeat(entry, below)
        by = np.lexsort((entry, ball))
        ball, entry = ball[by], entry[by]
    none = np.zeros(0, np.int64)
    return Walk(np.concatenate([none, *owned]), np.concatenate([none, *owners]), np.concatenate([none, *loose]), np.concatenate([none, *of_loose]))


def compared(tree: Tree, points: np.ndarray, books: np.ndarray, ball: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the listed entries for every point of the listed leaves, in integers, ties to the lower entry."""
    starts = np.concatenate([[0], np.nonzero(np.diff(ball))[0] + 1])
    listed = np.diff(np.append(starts, len(ball)))
    leaf = ball[starts]
    count = tree.last[leaf] - tree.first[leaf]
    found, nearest = [], []
    block = np.cumsum(count * listed) // COMPARED
    for of_block in np.split(np.arange(len(leaf)), np.nonzero(np.diff(block))[0] + 1):
        number, entries = count[of_block], listed[of_block]
        place = np.repeat(tree.first[leaf[of_block]], number) + ranges(number)
        each = np.repeat(entries, number)  # entries to compare each point with
        row = np.repeat(np.repeat(starts[of_block], number), each) + ranges(each)
        position = np.repeat(tree.position[leaf[of_block]], number * entries)
        far = ((points[np.repeat(tree.order[place], each)] - books[position, entry[row]]) ** 2).sum(axis=1)
        least = np.minimum.reduceat(far * books.shape[1] + entry[row], np.cumsum(each) - each)
        found.append(tree.order[place])
        nearest.append(least % books.shape[1])
    return np.concatenate(found), np.concatenate(nearest)


def summed(tree: Tree, values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and numbers of the parts nearest to each entry of each position."""
    positions, entries, size = books.shape
    walk = walked(tree, values, books)
    sums, counts = np.zeros((positions * entries, size), np.int64), np.zeros(positions * entries, np.int64)
    at = tree.position[walk.balls] * entries + walk.entries
    np.add.at(sums, at, tree.total[walk.balls])
    np.add.at(counts, at, tree.last[walk.balls] - tree.first[walk.balls])
    at = walk.loose // values.shape[1] * entries + walk.of_loose
    np.add.at(sums, at, values.reshape(-1, size)[walk.loose])
    np.add.at(counts, at, 1)
    return sums.reshape(positions, entries, size), counts.reshape(positions, entries)


def assigned(tree: Tree, values: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The entry of every part: positions x vectors."""
    walk = walked(tree, values, books)
    out = np.zeros(values.shape[0] * values.shape[1], np.int64)
    count = tree.last[walk.balls] - tree.first[walk.balls]
    out[tree.order[np.repeat(tree.first[walk.balls], count) + ranges(count)]] = np.repeat(walk.entries, count)
    out[walk.loose] = walk.of_loose
    return out.reshape(values.shape[:2])


def integers(vectors: DataFrame, vector: str) -> DataFrame:
    """vec_id, label, and ``parts``: the components as integers. Vectors that cannot be coded are gone."""
    scaled = lambda x: x.cast("double") * SCALE
    fine = lambda x: (~F.isnan(x) & (F.abs(scaled(x)) < MOST)).eqNullSafe(True)
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & F.forall(v, fine)
    parts = F.transform(v, lambda x: F.floor(scaled(x)).cast("int"))
    return vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), parts.alias("parts"))


def least_first(rows: DataFrame, number: int) -> list[list[int]]:
    """Parts of the rows with the least ids (rows without an id come last)."""
    return [r.parts for r in rows.select("vec_id", "parts").orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(number).collect()]


def seeds(first: list[list[int]]) -> np.ndarray:
    """Positions x entries x components."""
    return np.array(first, np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)


KINDS = {"pivot": np.float64, "radius": np.float64, "total": np.int64}


def trees(rows: DataFrame, size: int) -> DataFrame:
    """One row per some thousand vectors of a task: ids, labels, parts and the tree over them."""
    chunk = max(1, CHUNK // (PARTS * size))
    label = rows.schema["label"].dataType.simpleString()
    names = ["ids", "labels", "parts", *(f"t_{n}" for n in Tree._fields)]

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, labels, parts = (t[c].combine_chunks() for c in ("vec_id", "label", "parts"))
        values = np.ascontiguousarray(parts.flatten().to_numpy().astype(np.int32).reshape(len(ids), PARTS, size).transpose(1, 0, 2))
        tree = built(values.astype(np.int64))
        blobs = [values, *(getattr(tree, n).astype(KINDS.get(n, np.int32)) for n in Tree._fields)]
        listed = [pa.ListArray.from_arrays([0, len(ids)], c) for c in (ids, labels)]
        return pa.RecordBatch.from_arrays([*listed, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=names)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, chunk - number)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                number += piece.num_rows
                if number == chunk:
                    yield packed(held)
                    held, number = [], 0
        if held:
            yield packed(held)

    schema = ", ".join(["ids array<bigint>", f"labels array<{label}>", *(f"{n} binary" for n in names[2:])])
    return rows.mapInArrow(all_of, schema)


def unpacked(row: dict, size: int) -> tuple[Tree, np.ndarray]:
    tree = {n: np.frombuffer(row[f"t_{n}"], KINDS.get(n, np.int32)) for n in Tree._fields}
    tree |= {n: tree[n].reshape(-1, size) for n in ("pivot", "total")}
    values = np.frombuffer(row["parts"], np.int32).astype(np.int64).reshape(PARTS, -1, size)
    return Tree(**tree), values


def blobs_of(batch: pa.RecordBatch) -> list[dict]:
    return batch.select([n for n in batch.schema.names if n == "parts" or n.startswith("t_")]).to_pylist()


def refined(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries replaced by the floor of their parts' mean; those that nothing is nearest to stay."""
    size = books.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in blobs_of(batch):
                total, count = (x.reshape(-1, *x.shape[2:]) for x in summed(*unpacked(row, size), books))
                used = np.nonzero(count)[0]
                columns = np.repeat(used, size).astype(np.int32), np.tile(np.arange(size, dtype=np.int32), len(used)), total[used].ravel(), np.repeat(count[used], size)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["entry", "component", "total", "number"])

    found = forest.drop("ids", "labels").mapInArrow(sums, "entry int, component int, total long, number long")
    added = found.groupBy("entry", "component").agg(F.sum("total").alias("total"), F.sum("number").alias("number"))
    new = books.reshape(-1, size).copy()
    for r in added.collect():  # at most positions x entries x components
        new[r.entry, r.component] = r.total // r.number
    return new.reshape(books.shape)


def coded(forest: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error per vector of the forest."""
    size = books.shape[2]
    label = forest.schema["labels"].dataType.elementType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(blobs_of(batch)):
                tree, values = unpacked(row, size)
                entry = assigned(tree, values, books)
                error = ((values - books[np.arange(PARTS)[:, None], entry]) ** 2).sum(axis=(0, 2))
                text = [c.tobytes().hex() for c in entry.T.astype(np.uint8)]
                listed = [batch.column(c).slice(at, 1).flatten() for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*listed, pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return forest.mapInArrow(codes, f"vec_id long, label {label}, code string, error long")


def vector_codes(vectors: DataFrame, vector: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vectors``: vec_id, label and the vector. Gives vec_id, label, code, error per vector, and the codebooks
    (positions x entries x components).

    Gone are vectors that are null or empty, hold null or non-finite components or such of 16 384 and more,
    or have a length that cannot be cut into 16 or differs from that of the least id. The codebooks
    start as the parts of the least ids (ties: the lesser components; null ids after all others); with fewer rows than
    entries they have that many entries. Rows with null or repeated ids are coded like any other.
    No rows give no rows and empty codebooks. Other columns are not looked at.
    """
    rows = integers(vectors, vector)
    first = least_first(rows, 1)
    length = len(first[0]) if first else PARTS
    rows = rows.where(F.size("parts") == length)
    books = seeds(least_first(rows, entries)) if first else np.zeros((PARTS, 0, 1), np.int64)
    forest = pinned(trees(rows, length // PARTS), "vector-trees")
    for _ in range(rounds if first else 0):
        books = refined(forest, books)
    return coded(forest, books), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(table(spark, sf_dir, "embeddings"))
    codes = pinned(codes, "vector-codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    of_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    both = codes.join(of_label, F.col("label").eqNullSafe(F.col("of_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    return f"""
n{n} AS (SELECT v.id, v.p, min(CAST(list_sum(list_transform(list_zip(v.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) * {ENTRIES} + e.e) AS k
  FROM parts v JOIN e{n} e ON v.p = e.p GROUP BY v.id, v.p)"""


def _books_sql(n: int) -> str:
    return f"""
m{n} AS (SELECT p, e, list(CAST(floor(s / c) AS BIGINT) ORDER BY i) AS x FROM (
    SELECT a.p, a.k % {ENTRIES} AS e, i, CAST(sum(v.x[i]) AS DOUBLE) AS s, count(*) AS c
    FROM n{n} a JOIN parts v ON a.id = v.id AND a.p = v.p, range(1, (SELECT len(any_value(x)) + 1 FROM parts)) r(i) GROUP BY ALL) GROUP BY p, e),
e{n + 1} AS (SELECT e.p, e.e, coalesce(m.x, e.x) AS x FROM e{n} e LEFT JOIN m{n} m ON e.p = m.p AND e.e = m.e)"""


SQL = f"""
WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p)),
e0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id) - 1 AS e, x FROM parts QUALIFY e < {ENTRIES}),
{','.join(_round_sql(n) + ',' + _books_sql(n) for n in range(ROUNDS))},{_round_sql(ROUNDS)},
coded AS (SELECT id, string_agg(printf('%02x', CAST(k % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error FROM n{ROUNDS} GROUP BY id),
digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM e{ROUNDS}))
SELECT c.id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded c JOIN kept k ON c.id = k.id, digest"""
