"""The queries with SQL against that SQL, the others against brute force, on the smallest data."""

import base64
import collections
import hashlib
import math
import os
import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from runledger.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def result(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{DATA}/documents.parquet")
    return dict(zip(d.doc_id, d.text))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cursor = con.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def words(text):
    return text.encode().lower().split()


def near_groups(docs):
    sets = {i: set(zip(*(w[k:] for k in range(5)))) if len(w := words(t)) >= 5 else ({tuple(w)} if w else set()) for i, t in docs.items()}
    up = {i: i for i in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in docs}


def test_minhash_dedup(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, "op2_minhash_dedup")}
    assert got == near_groups(docs)
    assert any(i != c for i, (_, c) in got.items())


def test_suffix_dedup(spark, docs):
    size = 400
    seen = collections.Counter()
    for t in docs.values():
        t = t.encode()
        seen.update(t[i : i + size] for i in range(len(t) - size + 1))
    for r in result(spark, "op3_suffix_dedup"):
        t = docs[r.doc_id].encode()
        mask = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                mask[i : i + size] = True
        kept = np.frombuffer(t, np.uint8)[~mask[:-1]].tobytes()
        runs = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def removed_lines(docs):
    """Lines to remove, by document, whatever their length: one edit for each 20 characters of the shorter, two at most."""
    lines = [(i, k, x) for i in sorted(docs) for k, x in enumerate(docs[i].split("\n")) if x.strip(" \t\n\v\f\r")]
    first = {}
    for i, k, x in lines:
        first.setdefault(x, (i, k))
    label = {x: x for x in first}
    letters = {x: collections.Counter(x) for x in first}
    by_size = collections.defaultdict(list)
    for x in first:
        by_size[len(x)].append(x)
    for n in by_size:
        edits = min(n // 20, 2)
        for x in by_size[n]:
            for y in (y for m in range(n, n + edits + 1) for y in by_size.get(m, ())):
                apart = sum(((letters[x] - letters[y]) + (letters[y] - letters[x])).values())
                if label[x] != label[y] and apart <= 2 * edits and distance(x, y) <= edits:
                    old, new = label[y], label[x]
                    label.update({z: new for z, c in label.items() if c == old})
    stays = {}
    for x, at in first.items():
        stays[label[x]] = min(at, stays.get(label[x], at))
    gone = collections.defaultdict(list)
    for i, k, x in lines:
        if (i, k) != stays[label[x]]:
            gone[i].append(k)
    return gone


def test_line_dedup(spark, docs):
    gone = removed_lines(docs)
    got = {r.doc_id: r.removed_lines for r in result(spark, "op4_line_dedup")}
    assert got == {i: ",".join(map(str, gone.get(i, []))) for i in docs}
    assert any(len(docs[i].split("\n")[k]) < 40 for i, ks in gone.items() for k in ks)


def leaks(docs, share=0.2):
    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    out = {}
    for item, text in zip(items.item_id, items.text):
        w = words(text)
        n, most = len(w), int(share * len(w))
        for i, t in docs.items():
            v = words(t)
            known = np.cumsum([0] + [x in set(w) for x in v])
            for a in range(max(0, len(v) - (n - most) + 1)):
                longest = min(a + n + most, len(v))
                if known[longest] - known[a] >= n - most:
                    for b in range(a + n - most, longest + 1):
                        if known[b] - known[a] >= n - most and (d := distance(v[a:b], w)) <= most:
                            out[i, item] = min(out.get((i, item), (n,)), (d, a, b))
    return out


def test_decontamination(spark, docs):
    got = {(r.doc_id, r.item_id): (r.edits, r.start, r.end) for r in result(spark, "op5_decontamination")}
    assert got == leaks(docs)
    assert got


def test_token_output(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in result(spark, "op7_token_output")}
    start = 0
    for i in sorted(docs):
        ids = library.encode(docs[i], add_special_tokens=False).ids + [0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_lm_scoring(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = collections.Counter(w for i, t in docs.items() if not held[i] for w in (*words(t), None))
    total, kinds = sum(c.values()), len(c)
    sums = np.zeros(2)
    for r in result(spark, "op8_lm_scoring"):
        w = (*words(docs[r.doc_id]), None)
        base = sum(math.log10((c[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        if r.held_out:
            sums += r.base_score, r.score
    assert sums[1] > sums[0]  # better on texts it has not seen


def test_packing_places_every_token_once(spark, docs):
    rows = result(spark, "op1_best_fit_packing")
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
        by_bin[r.bin_id, r.bin_size].append((r.bin_offset, r.length))
    for i, t in docs.items():
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(t.encode().split()) + 1
    assert len({b for b, _ in by_bin}) == len(by_bin)
    for (_, size), held in by_bin.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size and size in (512, 1024, 2048, 4096)
        assert not any(at <= s < size for s in (512, 1024, 2048))  # cut down to its contents


def test_warc_digests(spark):
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    html = dict(zip(pages.page_id, pages.html))
    for r in result(spark, "op10_warc"):
        raw = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())


def good(text):
    w = text.encode().split()
    s = text.split()
    n, chars = len(w), sum(len(x.decode()) for x in w)
    windows = collections.defaultdict(list)
    for i in range(n - 4):
        windows[tuple(w[i : i + 5])].append(i)
    repeated = len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)})
    lines = [x for x in text.split("\n") if x.encode().split()]
    count = lambda chars_: sum(text.count(c) for c in chars_)
    import unicodedata

    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    assert len(s) == n
    return not (
        n < 10 or 100 * repeated > 20 * n or 10 * count("#*$%&|<>") > n or chars < 2 * n or chars > 15 * n or 10 * upper > 3 * chars
        or 10 * text.count("!") > 3 * n or 2 * (len(lines) - len(set(lines))) > len(lines) or 5 * sum(a == b for a, b in zip(w, w[1:])) > n)


def test_pipeline(spark, docs):
    left = {i: t for i, t in docs.items() if good(t)}
    gone = removed_lines(left)
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in left.items()}
    left = {i: t for i, t in cut.items() if i not in gone or len(t.encode().split()) >= 10}
    left = {i: left[i] for i, (_, c) in near_groups(left).items() if i == c}
    bad = {i for i, _ in leaks(left)}
    left = {i: t for i, t in left.items() if i not in bad}
    rows = corpus_pipeline.run(spark, DATA).collect()
    got = collections.Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == {i: len(t.encode().split()) + 1 for i, t in left.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "decontamination", "best_fit_packing"]
