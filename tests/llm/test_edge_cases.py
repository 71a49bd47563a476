"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; planted cases."""

import base64
import collections
import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runledger.llm import (decontamination, line_dedup, lm_scoring, minhash_dedup, packing, pipeline, quality_rules, substring_dedup, suffix_dedup,
                           token_output, warc)
from runledger.llm.components import components

random.seed(7)
VOCABULARY = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    w = r.choices(VOCABULARY, k=n)
    return "".join(x + ("\n" if i % 12 == 11 else " ") for i, x in enumerate(w)).strip()


A, B = prose(150, 1), prose(160, 2)
PASSAGE = prose(80, 3)
NEAR = A.replace(A.split()[70], "changed", 1)
LONG = prose(20_000, 4)
TEXTS = [
    (1, A), (2, A), (3, NEAR), (4, B), (5, ""), (6, None), (None, prose(60, 5)), (None, None), (7, "a b"), (8, " \n\t "), (9, LONG),
    (10, prose(50, 6) + "\n" + PASSAGE + "\n" + prose(50, 7)), (11, prose(50, 8) + "\n" + PASSAGE), (12, "é" * 900), (4, B), (13, "x"),
]
#: names that the operators use inside
CLASH = ["node", "component", "removed", "value", "line", "id", "text_hash", "failed_rule", "row", "q_row", "q_words", "kept", "n_tokens", "a", "key", "gone_id"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, "en", None, len(t[1]) if t[1] else None, *range(len(CLASH))) for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (None, A), (3, ""), (4, prose(30, 99))], "item_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_keeps_columns_and_takes_an_empty_table(spark, docs, none, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        rows = out.collect()
        assert all(r[c] == i for r in rows for i, c in enumerate(CLASH)), name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_empty_tables(spark, none, benchmark):
    for df in (substring_dedup.substring_dedup(none), suffix_dedup.suffix_dedup(none), minhash_dedup.near_duplicates(none), lm_scoring.scored(none),
               decontamination.matches(none, benchmark), packing.pack_documents(none), quality_rules.judged(none)):
        assert df.count() == 0
    assert decontamination.matches(none, benchmark.where("false")).count() == 0


def test_quality_rules(docs):
    rows = quality_rules.judged(docs).collect()
    assert len(rows) == len(TEXTS)
    failed = {r.doc_id: r.failed_rule for r in rows if r.doc_id is not None}
    assert {i for i, f in failed.items() if f is None} == {1, 2, 3, 4, 9, 10, 11}
    assert failed[6] == failed[5] == failed[8] == "few_words"


def test_line_dedup(docs):
    rows = line_dedup.dedup_lines(docs, least_words=10).collect()
    got = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    assert got[1] == A and 2 not in got and got[9] == LONG and got[5] == "" and got[6] is None and got[7] == "a b"
    assert sum(r.doc_id == 4 for r in rows) == 2 and got[4] == B  # repeated rows share one outcome
    assert [x for x in got[3].split("\n") if "changed" in x] and len(got[3]) < len(NEAR)
    assert not any(len(x) >= 40 for x in got[11].split("\n") if x in PASSAGE)
    assert all(r.n_chars == (len(r.text) if r.text else None if r.text is None else r.n_chars) for r in rows if r.doc_id == 3)


def test_minhash_dedup(docs):
    rows = minhash_dedup.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {i for i, r in got.items() if r.component_id == 1} == {1, 2, 3}
    assert [i for i in (1, 2, 3) if got[i].kept] == [1]
    assert got[5].n_shingles == got[6].n_shingles == got[8].n_shingles == 0 and got[5].kept and got[7].n_shingles == 1
    kept = minhash_dedup.drop_near_duplicates(docs).collect()
    assert sum(r.doc_id is None for r in kept) == 2 and sum(r.doc_id == 4 for r in kept) == 2


def test_a_chain_of_copies_and_a_large_family(spark):
    r = random.Random(5)
    words = prose(200, 11).split()
    rows, text = [], list(words)
    for i in range(12):  # each a little further from the first
        rows.append((i, " ".join(text)))
        for k in range(i * 16, i * 16 + 3):
            text[k % 200] = f"w{i}x{k}"
    for i in range(100, 260):  # copies of one text with one to twelve words changed
        copy = prose(180, 12).split()
        for k in r.sample(range(180), r.randint(1, 12)):
            copy[k] = f"v{i}y{k}"
        rows.append((i, " ".join(copy)))
    rows.append((99, prose(180, 12).replace("\n", " ")))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: root(i) for i in sets}
    assert len({root(i) for i in range(100, 260)}) > 10


def test_substring_and_suffix_dedup(docs):
    words = substring_dedup.substring_dedup(docs).collect()
    assert len(words) == len(TEXTS)
    got = {r.doc_id: r for r in words if r.doc_id is not None}
    assert got[1].n_removed == got[2].n_removed == 150 and got[1].text == ""
    assert got[10].n_removed >= 80 and got[9].n_removed == 0 and got[9].text == " ".join(LONG.split())
    assert got[4].n_removed == 160 and got[6].n_words == 0 and got[12].n_words == 1
    suffix = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect() if r.doc_id is not None}
    assert suffix[1].n_removed == len(A) and bytes(suffix[1].kept) == b"" and suffix[9].n_removed == 0
    assert suffix[12].n_removed == 1800  # it repeats itself
    assert suffix[6].n_bytes == 0 and suffix[10].n_removed >= len(PASSAGE) and [len(suffix[i].spans) for i in (10, 11)] == [1, 1]


def test_suffix_dedup_of_random_bytes_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    base = "".join(r.choices("ab ", k=1500))
    for i in range(40):
        parts = [base[(a := r.randint(0, 1400)) : a + r.randint(20, 200)] if r.random() < 0.5 else "".join(r.choices("ab ", k=r.randint(0, 150))) for _ in range(r.randint(0, 6))]
        rows.append((i, "".join(parts)))
    size = 130
    seen = {}
    for i, t in rows:
        for k in range(len(t) - size + 1):
            seen[t[k : k + size]] = seen.get(t[k : k + size], 0) + 1
    got = {x.doc_id: [(s.start, s.end) for s in x.spans] for x in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()}
    for i, t in rows:
        mask = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - size + 1):
            if seen[t[k : k + size]] > 1:
                mask[k + 1 : k + 1 + size] = True
        edges = np.flatnonzero(np.diff(mask.astype(int))).tolist()
        assert got[i] == list(zip(edges[::2], edges[1::2])), i
    assert any(got.values())


def test_loser_tree_gives_sorted_suffixes_with_common_prefixes():
    r = random.Random(2)
    runs = [sorted({bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(r.randint(0, 30))}) for _ in range(7)]
    entry = lambda s: (s, b"xy", 0, 1, hashlib.blake2b(s, digest_size=16).digest())
    for some in (runs, runs[:1], runs[:2]):
        coded = [suffix_dedup.front_coded([entry(s) for s in x]) for x in some if x]
        got = list(suffix_dedup.LoserTree([suffix_dedup.decoded(c) for c in coded]))
        suffixes = [e[0] for _, e in got]
        assert suffixes == sorted(s for x in some for s in x)
        for (c, (s, *_)), before in zip(got[1:], suffixes):
            assert c == suffix_dedup.shared_prefix(before, s, 0)
        assert all(e[1] == b"xy" and e[4] == entry(e[0])[4] for _, e in got)


def test_edit_distance_within(spark):
    r = random.Random(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = set()
    for _ in range(300):
        a = r.choices("abé", k=r.randint(0, 12))
        b = list(a)
        for _ in range(r.randint(0, 4)):
            k, kind = r.randint(0, len(b)), r.choice((0, 1, 2))
            b[k : k + (kind != 0)] = [r.choice("abé")] if kind != 2 else []
        pairs.add(("".join(a), "".join(b)))
    df = spark.createDataFrame(sorted(pairs), "s string, t string")
    for edits in (1, 2, 3):
        assert {tuple(x) for x in line_dedup.within(df, edits).collect()} == {p for p in pairs if distance(*p) <= edits}
    for a, b in sorted(pairs):
        if b:
            assert decontamination.edit_distance(list(a), decontamination.masks_of(list(b)), len(b)) == distance(a, b)


def test_short_lines_go_when_repeated(spark):
    long, mid = "a line of well over forty characters stands here", "twenty to forty chars here"
    texts = [
        f"Menu\n\n{mid}\n{long}\nshort one\n \t", "Menu\n\nshort one\n \t\nshort ona\nMenu", mid.replace("forty", "fourty") + "\nown",
        mid.replace("twenty to", "twelve to") + "\nown\n}", long.replace("line of", "lime off") + "\n}",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.removals(docs).collect()} == {1: [0, 2, 5], 2: [0], 3: [1], 4: [0, 1]}


def test_line_links_find_every_edit(spark):
    r = random.Random(4)
    rows = []
    for i in range(120):
        line = "".join(r.choices("abcdefgh ", k=r.randint(40, 60)))
        other = list(line)
        for _ in range(2):
            k, kind = r.randint(0, len(other)), r.choice((0, 1, 2))
            other[k : k + (kind != 0)] = [r.choice("abcdefgh ")] if kind != 2 else []
        rows += [(2 * i, line), (2 * i + 1, "".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.removals(docs, least_chars=30).collect()}
    assert gone == {2 * i + 1 for i in range(120)}


def test_decontamination_recall(spark, benchmark):
    r = random.Random(6)
    items = [(i, prose(r.randint(15, 60), 200 + i)) for i in range(30)]
    rows, planted = [], set()
    for i in range(300):
        item, text = items[i % 30]
        w = text.split()
        for _ in range(r.randint(0, int(0.2 * len(w)))):
            k, kind = r.randint(0, len(w) - 1), r.choice((0, 1, 2))
            w[k : k + (kind != 0)] = [f"new{i}"] if kind != 2 else []
        rows.append((i, prose(40, 1000 + i) + " " + " ".join(w).upper() + " " + prose(40, 2000 + i)))
        masks = decontamination.masks_of(text.split())
        all_words, n = rows[-1][1].lower().split(), len(text.split())
        if min(decontamination.nearest_prefix(all_words[a : a + 2 * n], masks, n)[0] for a in range(len(all_words))) <= int(0.2 * n):
            planted.add((i, item))
    rows += [(300 + i, prose(200, 5000 + i)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= planted and len(got) >= 0.99 * len(planted) and len(planted) > 200


@pytest.mark.parametrize("n", [15, 40, 150, 600])
def test_decontamination_finds_inserted_words_at_every_length(n):
    r = random.Random(n)
    items = [(i, prose(n, 300 + i).encode()) for i in range(4)]
    index = decontamination.Index(items)
    missed, most = 0, int(0.2 * n)
    for k in range(100):
        w = items[k % 4][1].decode().split()
        for j in range(most - k % 3):  # insertions alone, up to all edits allowed
            w.insert(r.randint(1, len(w) - 1), f"new{j}")
        text = (prose(30, 7000 + k) + " " + " ".join(w) + " " + prose(30, 8000 + k)).encode()
        found = {m[0]: m[3] for m in index.matches([text]).get(0, [])}
        missed += found.get(k % 4, n) > most
    assert missed <= 1


def test_decontamination_index_is_built_for_many_lengths():
    start = time.perf_counter()
    index = decontamination.Index([(i, prose(10 + i, i).encode()) for i in range(300)])
    assert len(index.bands) <= 20 and time.perf_counter() - start < 60
    text = prose(40, 1) + " " + prose(210, 200) + " " + prose(40, 2)
    assert (200, 40, 250, 0) in index.matches([text.encode()])[0]


def test_decontamination_of_items_without_id(spark, docs):
    items = spark.createDataFrame([(None, PASSAGE), (None, "of no text at all " * 5), (1, PASSAGE), (2, None), (3, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.matches(docs, items).collect()} == {(10, None), (11, None), (10, 1), (11, 1)}
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, items.where("item_id IS NULL")).collect()}
    assert not kept & {10, 11} and 9 in kept


def test_decontamination_in_blocks(spark, docs, benchmark, monkeypatch):
    whole = sorted(map(tuple, decontamination.matches(docs, benchmark).collect()), key=str)
    # the item without an id is searched as well
    assert {(d, i) for d, i, *_ in whole} == {(10, 1), (11, 1), (1, None), (2, None), (3, None)}
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 1)
    assert sorted(map(tuple, decontamination.matches(docs, benchmark).collect()), key=str) == whole
    assert 10 not in {r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()}


def test_token_files(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    from runledger.session import new_work_path

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = new_work_path(spark, "tokens-test")
    token_output.write_tokens(docs, path, out, shard_tokens=5000)
    rows = token_output.with_global_start(token_output.read_tokens(spark, out)).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    want = sorted(((i is not None, i or 0, t or "") for i, t in TEXTS))
    start = 0
    for r, (_, i, t) in zip(rows, want, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        assert (r.doc_id or 0, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (i, start, ids)
        start += len(ids)
    out = new_work_path(spark, "tokens-test")
    token_output.write_tokens(none, path, out)
    assert token_output.read_tokens(spark, out).count() == 0


def test_irregular_white_space_is_encoded_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_output.Encoder(path)
    r = random.Random(9)
    texts = ["".join(r.choices(["a", "bc", "é", "1", "'s", " ", " ", "\n", "\t", " ", ".", "!!"], k=r.randint(0, 30))) for _ in range(500)]
    for _ in range(2):
        for t, raw in zip(texts, own.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_added_tokens_are_encoded_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_output.Encoder(path)
    added = [x.content for x in library.get_added_tokens_decoder().values()]
    r = random.Random(10)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>.", "<|endoftext", "|>"]
    texts += ["".join(r.choices([*added, "<|", "endoftext", "|>", "a", " bc", "\n", ".", " "], k=r.randint(1, 12))) for _ in range(300)]
    assert added and 50256 in library.encode(texts[0], add_special_tokens=False).ids
    for t, raw in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_single_tokens_are_addressable():
    r = np.random.default_rng(1)
    ids = [r.integers(0, m, n).astype(np.uint32) for m, n in ((50257, 3000), (200, 700), (2**31, 900), (1, 5))]
    shard = token_output.Shard(token_output.shard(3, 10, 0, [5, None, 6, 7], ids))
    flat = np.concatenate(ids)
    assert shard.ids().tolist() == flat.tolist() and shard.ends.tolist() == np.cumsum([len(x) for x in ids]).tolist()
    assert [shard.token(i) for i in range(0, len(flat), 37)] == flat[::37].tolist()


def test_lm_scores(docs):
    rows = lm_scoring.scored(docs).collect()
    assert len(rows) == len(TEXTS)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[5].n_tokens == got[6].n_tokens == 1 and got[9].n_tokens == 20_001
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert len({(r.score, r.n_tokens) for r in rows if r.doc_id == 4}) == 1


def suffix_tree_scores(docs, depth, divergence, least):
    """By doc_id: score of a plain suffix tree over dicts, from all (context, next) pairs."""
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    symbols = {i: ["<start>", *t.encode().lower().split(), "<end>"] for i, t in docs.items()}
    trained = [x for i, x in symbols.items() if not held[i]]
    of_symbol = collections.Counter(s for x in trained for s in x[1:])
    everything = of_symbol.total() + 0.1 * (len(of_symbol) + 1)
    nexts = collections.defaultdict(collections.Counter)
    for x in trained:
        for j in range(1, len(x)):
            for d in range(1, min(depth, j) + 1):
                nexts[tuple(x[j - d : j])][x[j]] += 1
    retained = {(): True}

    def p(c, s):
        if not c:
            return (of_symbol[s] + 0.1) / everything
        if not retained.get(c):
            return p(c[1:], s)
        n, k = nexts[c].total(), len(nexts[c])
        return (nexts[c][s] + (k + 1) * p(c[1:], s)) / (n + k + 1)

    for c in sorted(nexts, key=len):
        n = nexts[c].total()
        gain = sum(m * math.log(m / n / p(c[1:], s)) for s, m in nexts[c].items())
        retained[c] = n >= least and gain > divergence * (len(nexts[c]) + 1)
    scores = {i: sum(math.log10(p(tuple(x[max(j - depth, 0) : j]), x[j])) for j in range(1, len(x))) for i, x in symbols.items()}
    return scores, sum(retained.values()) - 1


@pytest.mark.parametrize("depth,least,parts", [(3, 2, 1), (3, 2, 4), (1, 2, 1), (4, 1, 3)])
def test_scores_are_those_of_a_whole_suffix_tree(spark, monkeypatch, depth, least, parts):
    r = random.Random(depth)
    vocabulary = [f"w{i}" for i in range(300)]
    phrases = [[r.choice(vocabulary) for _ in range(r.randint(3, 7))] for _ in range(150)]
    docs = {i: " ".join(w for _ in range(r.randint(0, 8)) for w in (r.choice(phrases) if r.random() < 0.7 else [f"Only{i}", r.choice(vocabulary)])) for i in range(400)}
    docs |= {1000: docs[1], 1001: docs[1], 1002: "", 1003: "w1", 1004: "Never " * 30}
    monkeypatch.setattr(lm_scoring, "PER_PART", 1)
    want, retained = suffix_tree_scores(docs, depth, lm_scoring.DIVERGENCE, least)
    assert retained > 100
    rows = lm_scoring.scored(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), depth=depth, least=least, parts=parts).collect()
    assert len(rows) == len(docs)
    for x in rows:
        assert x.score == pytest.approx(want[x.doc_id], rel=1e-9), x.doc_id


def test_line_dedup_frees_what_it_shuffled(spark, monkeypatch):
    freed, pinned = {}, line_dedup.pinned
    monkeypatch.setattr(line_dedup, "pinned", lambda df, label, free=False: freed.update({label: free}) or pinned(df, label, free))
    docs = spark.createDataFrame([(1, "the same line\nanother"), (2, "the same line")], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.removals(docs).collect()} == {2: [0]}
    assert freed["line-links"] and freed["repeated-lines"]


@pytest.mark.parametrize("depth,heavy,parts", [(3, 60, 1), (3, 25, 4), (4, 8, 2), (1, 60, 2)])
def test_scores_with_many_buckets_and_contexts_counted_by_spark(spark, monkeypatch, depth, heavy, parts):
    """Chunks, buckets and the bound beyond which a context is not one bucket's affair change no score."""
    r = random.Random(depth)
    phrases = [[f"w{int(300 * r.random() ** 3)}" for _ in range(r.randint(3, 7))] for _ in range(60)]
    docs = {i: " ".join(w for _ in range(r.randint(0, 8)) for w in (r.choice(phrases) if r.random() < 0.7 else [f"Only{i}", "w0"])) for i in range(300)}
    docs |= {1000: docs[1], 1001: docs[1], 1002: "", 1003: "w1", 1004: "Never " * 300}
    for name, value in (("PER_PART", 1), ("CHUNK", 500), ("BUCKET", 100), ("HEAVY", heavy), ("PER_FILE", 2)):
        monkeypatch.setattr(lm_scoring, name, value)
    counted = []
    supply = lm_scoring.heavy_supply
    monkeypatch.setattr(lm_scoring, "heavy_supply", lambda chunks, model, *x: counted.append(len(model.heavy)) or supply(chunks, model, *x))
    want, _ = suffix_tree_scores(docs, depth, lm_scoring.DIVERGENCE, 2)
    rows = lm_scoring.scored(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), depth=depth, parts=parts).collect()
    assert max(counted) == depth
    assert len(rows) == len(docs)
    for x in rows:
        assert x.score == pytest.approx(want[x.doc_id], rel=1e-9), x.doc_id


def test_a_context_stays_in_a_corpus_that_grows(spark):
    """A pair of words seen a few times tells the next one, however many other texts there are."""
    r = random.Random(3)
    rows = [(i, "alpha beta gamma delta") for i in range(1, 7)]
    rows += [(i, " ".join(f"x{r.randrange(40)}" for _ in range(300))) for i in range(100, 1100)]
    got = {x.doc_id: x for x in lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].score - got[3].base_score > 8


def test_next_symbol_distributions_sum_to_one(spark):
    r = random.Random(8)
    rows = [(i, " ".join("ab"[r.random() < (0.9 if k % 2 else 0.1)] for k in range(60))) for i in range(200)]
    trees = []
    kept = lm_scoring.grown

    def grown(tree, *args):
        kept(tree, *args)
        trees.append(tree)

    lm_scoring.grown = grown
    try:
        lm_scoring.scored(spark.createDataFrame(rows, "doc_id long, text string"), context_share=1e-3).count()
    finally:
        lm_scoring.grown = kept
    tree = trees[-1]
    for depth, level in enumerate(tree.levels, 1):
        assert level.retained.any()
        for c in level.contexts[level.retained]:
            p = 10.0 ** lm_scoring.log_next(tree, depth, np.full(tree.symbols, c), np.arange(tree.symbols))
            assert p.sum() == pytest.approx(1, abs=1e-3)


def test_packing(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, 0, 1, 7, 100, 300, 511, 512, 513, 4096, 9000])) for i in range(2000)] + [(None, 100), (5, 100), (5, 100)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    assert sum(x.length for x in out) == sum(n or 0 for _, n in rows)
    bins = {}
    for x in out:
        bins.setdefault((x.bin_id, x.bin_size), []).append((x.bin_offset, x.length))
    for (_, size), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= size and not any(at <= s < size for s in packing.SIZES)


def test_grouped_packing_is_best_fit():
    """With one bin size, the plan is what best fit gives piece by piece."""
    r = random.Random(2)
    histogram = {n: r.randint(1, 40) for n in r.sample(range(1, 1001), 150)}
    plan = packing.planned(histogram, (1000,))
    held = {}
    for row in range(len(plan.length)):
        length, rank = int(plan.length[row]), int(plan.rank[row])
        later = [int(x) for x in plan.rank[plan.length == length] if x > rank]
        for i in range(rank, min(later, default=histogram[length])):
            held.setdefault(int(plan.bin[row]) + (i - rank) // int(plan.each[row]), []).append(length)
    bins = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            fits = [b for b in bins if 1000 - sum(b) >= n]
            if fits:
                max(fits, key=sum).append(n)
            else:
                bins.append([n])
    assert sorted(map(sum, held.values())) == sorted(map(sum, bins))  # bins with equal room are interchangeable


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:runledger:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_rejects_magic_inside_payloads(spark, compression):
    from runledger.session import new_work_path

    pages = [
        (1, "u", INNER), (2, "u", INNER * 3 + "tail"), (3, "u", "x WARC/1.1\r\nContent-Length: 999\r\n\r\n"), (4, None, None), (5, "u", ""), (6, "u", "plain"),
        (7, "a\r\nb", "plain"), (None, "u", "plain"), (8, "u", "WARC/1.1\r\n"), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n\r\n"), (6, "u", "plain"), (10, "u", INNER + "WARC/1.1\r\n" + INNER)]
    path = new_work_path(spark, "warc-test")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("size", F.lit(2))
    warc.write_warc(df.repartition(2), path, compression=compression, records_per_file=3)
    got = sorted(map(tuple, warc.read_warc(spark, path).drop("url").collect()), key=repr)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    path = new_work_path(spark, "warc-test")
    warc.write_warc(df.where("false"), path, compression=compression)
    assert warc.read_warc(spark, path).count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 200)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    up = {x: x for p in links for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_a_repeated_string_leaves_its_range_once(spark):
    """However many runs bring the surroundings of an anchor, one row per digest is joined with its places."""
    suffix, before = bytes(random.Random(3).choices(range(32, 127), k=500)), b"before"
    entries = [(suffix, before, 0, 1, bytes(16)), (suffix, b"other", 0, 1, bytes(15) + b"1")]
    rows = list(suffix_dedup.merged([suffix_dedup.front_coded([e]) for e in (entries * 40)], 400))
    assert sorted(r[0] for r in rows) == sorted(e[4] for e in entries)
    alone = list(suffix_dedup.merged([suffix_dedup.front_coded([entries[0]])], 400))
    assert not alone
