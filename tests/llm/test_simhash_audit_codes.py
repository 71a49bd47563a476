"""Anchor covering, removal steps and metric trees against brute force, odd inputs, planted cases."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from runledger.llm import filter_audit as A, simhash_dedup as S, vector_codes as V

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
given = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
CLASH = ["bits", "anchor", "node", "component", "root", "part", "mask", "digest", "good", "fails", "entry", "parts", "ids", "at"]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


# SimHash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in (list(zip(w, w[1:], w[2:])) or [w][: len(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs):
    """Component of each row of (doc_id, fingerprint), compared with all others."""
    prints = np.array([f for _, f in docs], np.uint64)
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in np.nonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= 3)[0].tolist():
            if label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = collections.defaultdict(list)
    for (i, _), x in zip(docs, label):
        least[x] += [] if i is None else [i]
    return collections.Counter((i, format(f, "016x"), min(least[x], default=None)) for (i, f), x in zip(docs, label))


def test_every_word_has_one_home_and_meets_what_is_near():
    rng = np.random.default_rng(3)
    x = rng.integers(-(2**63), 2**63, 20_000)
    row, home = S.anchors(x, 0)
    assert sorted(row.tolist()) == list(range(len(x)))
    home = home[np.argsort(row)]
    for different in (1, 2, 3):
        y = x[:1500].copy()
        for _ in range(different):
            y ^= np.int64(1) << rng.integers(0, 64, len(y))
        row, anchor = S.anchors(y, different)
        at = set(zip(row.tolist(), anchor.tolist()))
        assert len(at) == len(row) and all((i, h) in at for i, h in enumerate(home[:1500].tolist()))


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(-(2**62), 2**62, 40)
    rows = set()
    for c in centres.tolist():
        for _ in range(40):
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                c ^= (1 << b) if b < 63 else -(1 << 63)
            rows.add(c)
    rows = sorted(rows)
    got = {(r.a, r.b) for r in S.links(spark.createDataFrame([(x, 0) for x in rows], "bits long, least long")).collect()}
    v = np.array(rows, np.int64).view(np.uint64)
    want = {(rows[i], rows[j]) for j in range(len(rows)) for i in np.nonzero(np.bitwise_count(v[:j] ^ v[j]) <= 3)[0].tolist()}
    assert got == want and len(want) > 500


def test_fingerprints_do_not_depend_on_slices(monkeypatch):
    random.seed(1)
    text = " ".join("".join(random.choices("abcdeé", k=random.randint(1, 9))) for _ in range(700)).upper()
    whole = fingerprint(text)
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(S, "word_slices", lambda data, s=size, f=S.__dict__["word_slices"]: f(data, s))
        assert S.fingerprint(text.encode()) == whole
        monkeypatch.undo()


@given
def test_simhash_query(spark):
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    got = collections.Counter(map(tuple, S.op11_simhash_dedup(spark, DATA).collect()))
    assert got == groups([(i, fingerprint(t)) for i, t in zip(d.doc_id.tolist(), d.text)])
    assert any(i != c for i, _, c in got)


def test_simhash_of_odd_rows(spark):
    random.seed(2)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(500)]
    long = " ".join(random.choices(words, k=30_000))
    texts = [(4, long), (3, long.replace(words[0], words[1], 1)), (9, ""), (7, None), (None, " \n "), (5, "one"), (5, "one"), (6, "ONE"), (None, "alone here"), (None, "alone here"), (8, "a b c")]
    docs = clashing(spark.createDataFrame(texts, "doc_id long, text string"))
    got = S.near_duplicates(docs)
    assert collections.Counter(map(tuple, got.collect())) == groups([(i, fingerprint(t)) for i, t in texts])
    assert {r.component_id for r in got.where("doc_id in (3, 4)").collect()} == {3}
    assert S.near_duplicates(docs.where("false")).count() == 0


def test_many_copies_and_one_chain(spark):
    """A hot fingerprint is one node; a chain of fingerprints, each three bits from the next, is one component."""
    text = "every word of this text stands in it once only"
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit(text)).otherwise(F.concat(F.lit("text number "), "id", F.lit(" of many others "), F.col("id") * 7)).alias("text"))
    got = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    assert {got[i] for i in range(3000) if i % 3 < 2} == {0}
    values = [0]
    for i in range(20):
        values.append(values[-1] ^ (7 << 3 * i))
    linked = S.components(S.links(spark.createDataFrame([(v, 0) for v in values], "bits long, least long"))).collect()
    assert {r.component for r in linked} == {0} and len(linked) == len(values)


# filters


def audit(docs, labels):
    """Applies every order, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in docs:
        text = text or ""
        w = text.encode().split()
        fails = ""
        fails += "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search("[#$%&*|]", text)) + "E" * (i is not None and least[text] < i)
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def test_removal_steps():
    steps, (names, _) = A.removal_steps(), A.orders()
    assert len(names) == math.factorial(5) == len(set(names))
    for failed in range(32):
        for k, order in enumerate(names):
            assert steps[failed, k] == min((order.index(f) + 1 for i, f in enumerate("ABCDE") if failed >> i & 1), default=6)


@given
def test_audit_query(spark):
    d, l = pd.read_parquet(f"{DATA}/documents.parquet"), pd.read_parquet(f"{DATA}/labels.parquet")
    got = result(A.op12_filter_audit(spark, DATA))
    assert got == audit(list(zip(d.doc_id.tolist(), d.text, d.lang)), list(zip(l.doc_id.tolist(), l.quality, l.toxic)))
    assert all(any(v[c] for v in got.values()) for c in range(7))


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    docs = [(1, long, "en"), (5, long, "de"), (5, long, "de"), (None, long, "en"), (2, None, None), (3, "", ""), (None, None, "en"), (7, "A# b", "en"), (6, "A# b", "en"),
            (8, "x " * 300, "en"), (8, "other", "en"), *[(100 + i, "same text", "hot") for i in range(400)]]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (5, None, 1), (7, 0, None), (3, 1, 1), (101, 1, 0), (999, 1, 1)]
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string")).drop("part").withColumn("part", F.lit(1))
    lab = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = result(A.filter_audit(d, lab))
    assert got == audit(docs, labels)
    assert A.filter_audit(d.where("false"), lab).count() == 0
    assert result(A.filter_audit(d, lab.where("false"))) == audit(docs, [])


# vector codes


def brute(values, books):
    return ((values[:, :, None] - books[:, None]) ** 2).sum(-1).argmin(-1)


@pytest.mark.parametrize("vectors, size, spread, copies", [(1, 4, 30, 0), (2, 1, 5, 0), (70, 4, 2, 0), (500, 4, 30, 0), (2000, 4, 32, 900), (1500, 1, 4, 0), (200, 48, 30, 20)])
def test_trees_give_what_comparing_all_gives(vectors, size, spread, copies):
    rng = np.random.default_rng(vectors)
    values = np.floor(rng.normal(0, spread, (16, vectors, size))).astype(np.int64)
    values[:, :copies] = values[:, :1]
    books = values[:, :64].copy()
    tree = V.built(values)
    assert sorted(tree.order.tolist()) == list(range(16 * vectors))
    for i in range(len(tree.radius)):  # caches and shape
        inside = tree.order[tree.first[i] : tree.last[i]]
        points = values.reshape(-1, size)[inside]
        assert (tree.total[i] == points.sum(axis=0)).all() and set(inside // vectors) == {tree.position[i]}
        assert (((points - tree.pivot[i]) ** 2).sum(axis=1) <= tree.radius[i] ** 2 + 1e-6).all()
        children = range(tree.child[i], tree.child[i] + tree.number[i])
        assert not children or sorted((tree.first[c], tree.last[c]) for c in children)[0][0] == tree.first[i] and sum(tree.last[c] - tree.first[c] for c in children) == len(inside)
    want = brute(values, books)
    assert (V.assigned(tree, values, books) == want).all()
    sums, counts = V.summed(tree, values, books)
    for p in range(16):
        total = np.zeros(books.shape[1:], np.int64)
        np.add.at(total, want[p], values[p])
        assert (sums[p] == total).all() and (counts[p] == np.bincount(want[p], minlength=books.shape[1])).all()


def test_far_clusters_are_owned_whole():
    """Balls far from all entries but one are never looked into."""
    rng = np.random.default_rng(0)
    values = np.floor(rng.normal(0, 3, (16, 3000, 4))).astype(np.int64) + rng.integers(0, 8, (16, 3000, 1)) * 1000
    books = np.arange(8)[None, :, None] * 1000 * np.ones((16, 1, 4), np.int64)
    walk = V.walked(V.built(values), values, books)
    assert len(walk.loose) == 0 and len(walk.balls) < 3000


def codes(rows, entries=64, rounds=2):
    """rows: (vec_id, label, ints), kept ones."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[2]))
    values = np.array([r[2] for r in rows], np.int64).reshape(len(rows), 16, -1).transpose(1, 0, 2)
    books = values[:, :entries].copy()
    for _ in range(rounds):
        nearest = brute(values, books)
        for p in range(16):
            for e in set(nearest[p].tolist()):
                books[p, e] = values[p][nearest[p] == e].sum(axis=0) // (nearest[p] == e).sum()
    nearest = brute(values, books)
    error = ((values - books[np.arange(16)[:, None], nearest]) ** 2).sum(axis=(0, 2))
    return collections.Counter((r[0], r[1], bytes(n.astype(np.uint8)).hex(), e) for r, n, e in zip(rows, nearest.T, error.tolist())), books


@given
def test_codes_query(spark):
    d = pd.read_parquet(f"{DATA}/embeddings.parquet")
    want, books = codes([(i, l, np.floor(v * 256).astype(int).tolist()) for i, l, v in zip(d.vec_id.tolist(), d.label.tolist(), d.embedding)])
    of_label = collections.Counter()
    for (_, label, _, error), n in want.items():
        of_label[label] += n * error
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    got = {r.vec_id: tuple(r)[1:] for r in V.op13_vector_codes(spark, DATA).collect()}
    assert got == {i: (code, error, of_label[label], digest) for i, label, code, error in want}


def test_codes_of_odd_rows(spark):
    rng = random.Random(3)
    vector = lambda: [rng.uniform(-2, 2) for _ in range(32)]
    same = vector()
    good = [(i if i % 9 else None, i % 3 if i % 4 else None, vector()) for i in range(1, 120)] + [(200, 1, same)] * 50 + [(5, 7, vector())]
    bad = [(0, 1, None), (0, 1, []), (0, 1, [None] * 32), (0, 1, [float("nan")] * 32), (0, 1, [float("-inf"), *same[1:]]), (0, 2, [1e30, *same[1:]]), (0, 1, [1.0] * 31), (500, 1, [1.0] * 16)]
    df = clashing(spark.createDataFrame(good + bad, "vec_id long, label int, embedding array<double>").repartition(3))
    got, books = V.vector_codes(df)
    want, want_books = codes([(i, l, [math.floor(256 * x) for x in v]) for i, l, v in good])
    assert (books == want_books).all()
    assert collections.Counter(map(tuple, got.collect())) == want
    assert V.vector_codes(df.where("false"))[0].count() == 0
    few, few_books = V.vector_codes(df.where("vec_id in (1, 2, 3)"))
    assert few.count() == 3 and few_books.shape == (16, 3, 2) and {r.error for r in few.collect()} == {0}
