"""Exact and near duplicates against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnwell.llm import near_dedup as nd
from tarnwell.llm import textscan as ts
from tarnwell.llm.components import components
from tarnwell.llm.exact_dedup import exact_dedup, kept_documents
from tarnwell.llm.shingles import Sets, exact_sets, shingle_sets, super_minhash

from .conftest import WORDS

COPIES = [(5, "a  b\tc"), (2, "a b c"), (9, "a b c"), (1, None), (4, ""), (3, " "), (7, "d" * 100_000), (8, "d" * 100_000), (6, "a b c "), (2, "a b c"), (None, "zz"), (None, "q"), (11, "q")]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_copies(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(normal(t), []).append(d)
    out = []
    for d, t in rows:
        own = groups[normal(t)]
        out.append((d, min((x for x in own if x is not None), default=None), len(own), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark, make):
    for digest in (None, lambda n: F.length(n) % 3):
        df = exact_dedup(make(COPIES)) if digest is None else exact_dedup(make(COPIES), digest=digest, salts=2, hot_share=5)
        rows = df.collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == brute_copies(COPIES)
        kept = [r for r in rows if r["kept"]]
        assert len(kept) == len({normal(t) for _, t in COPIES})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup(make([])).collect() == []


def test_hot_groups_are_salted(spark, make):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)]
    got = exact_dedup(make(rows), hot_share=10, salts=8).collect()
    assert {r["keep_id"] for r in got if r["doc_id"] < 400} == {0}
    assert {r["group_size"] for r in got if r["doc_id"] < 400} == {400}
    assert sum(r["kept"] for r in got) == 51


def test_kept_documents_keep_columns(spark, make):
    docs = make(COPIES)
    kept = kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({normal(t) for _, t in COPIES})
    assert {r["h"] for r in kept.collect()} == {"x"}
    assert kept_documents(make([])).collect() == []


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_links(rows, k, percent=80):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(seed, n=70, long=60):
    """Chains of edited texts, exact copies, short and empty ones."""
    rnd, rows = random.Random(seed), []
    base = [rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(long)]
    for i in range(n):
        if rnd.random() < 0.2:
            base = [rnd.choice(WORDS) + str(rnd.randrange(9)) for _ in range(long)]
        words = list(base)
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(long)] = "edit" + str(rnd.randrange(1000))
        if rnd.random() < 0.3:
            base = words
        rows.append((i, " ".join(words)))
    more = [None, "", "  ", "One", "one", "a b c", "A  b\nc", "a b d", "x y z w", "x y z w"]
    return rows + [(n + i, t) for i, t in enumerate(more)]


def test_shingle_sets_and_signatures():
    texts = [t for _, t in family(1)] + ["aa" * 50_000, "É é A a ß"]
    sets = shingle_sets(pa.array(texts), 4)
    assert [len(sets[i]) for i in range(len(texts))] == [len(shingles(t, 4)) for t in texts]
    signatures = super_minhash(sets, 128)
    assert signatures.shape == (len(texts), 128)
    n, off = 300, []
    for q in range(60):
        a = ts.mixed(np.arange(n, dtype=np.uint64) + np.uint64(q * 10_000))
        b = np.concatenate([a[:200], ts.mixed(np.arange(100, dtype=np.uint64) + np.uint64(q * 10_000 + 5000))])
        s = super_minhash(Sets(np.concatenate([a, b]), np.array([0, n, 2 * n])), 128)
        off.append((s[0] == s[1]).mean() - 0.5)
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.06


def test_near_dedup(spark, make):
    for seed, k in ((1, 4), (2, 5)):
        rows = family(seed)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_dedup(make(rows), k=k).collect()}
        assert got == {d: (n, c, c == d) for d, (n, c) in brute_links(rows, k).items()}


def test_buckets_of_several_components_are_worked_off(spark, make, monkeypatch):
    monkeypatch.setattr(nd, "TILE", 8)
    rows = family(7, n=60, long=24)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(make(rows), k=2).collect()}
    assert got == {d: c for d, (_, c) in brute_links(rows, 2).items()}


def test_near_dedup_odd_tables(spark, make):
    assert nd.near_dedup(make([])).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "own words only here now"), (3, None)]
    got = sorted((tuple(r) for r in nd.near_dedup(make(rows), k=4).collect()), key=str)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 2, None, True), (3, 0, 3, True)], key=str)
    assert nd.representatives(make(rows)).columns == make(rows).columns


def swapped(n, a, b):
    """Two words of ``n`` letters, the Thue-Morse order of two letters and its complement."""
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word, word.translate(str.maketrans(a + b, b + a))


def test_long_words_that_polynomials_confuse_stay_apart(spark, make):
    rows, at = [], 0
    for n in (1024, 2048, 4096):
        for word in swapped(n, "a", "b"):
            rows.append((at, f"{word} x y z w"))
            at += 1
    got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(make(rows), k=4).collect()}
    assert got == {d: d for d, _ in rows}


def test_links_hold_where_all_hashes_collide(monkeypatch):
    """Under seeds whose hashes tell nothing apart, exact sets are still exact."""
    real, seeds = ts.span_hashes, []

    def weak(codes, starts, ends, seed=0):
        seeds.append(seed)
        return np.full(len(starts), 7, np.uint64) if seed < 2 else real(codes, starts, ends, seed)

    monkeypatch.setattr(ts, "span_hashes", weak)
    texts = [t for _, t in family(3, n=20)]
    sets = exact_sets(pa.array(texts), 4)
    own = [shingles(t, 4) for t in texts]
    assert seeds == [0, 1, 2]
    for i, a in enumerate(own):
        for j, b in enumerate(own):
            assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)


def test_spans_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(ts, "span_hashes", lambda codes, starts, ends, seed=0: np.uint64(5) + (ends - starts).astype(np.uint64))
    table, told = ts.SpanTable(10), {}

    def learn(first, at):
        for n, i in enumerate(at.tolist(), first):
            told[n] = text[starts[i] : ends[i]]

    for text in ("ab ba ab b a", "ba ab cc a", "xyz ab ba"):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends = ts.runs(codes != 32)
        found = table.numbers(codes, starts, ends, learn)
        assert [told[n] for n in found.tolist()] == text.split()


def brute_representatives(rows, k):
    """One row of each component (least doc_id, null last), all wordless ones, of equal rows one."""
    rows = list(dict.fromkeys(r for r in rows if r[0] is not None)) + [r for r in rows if r[0] is None]
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min((r[0] for r in own if r[0] is not None), default=None) for own in groups.values()], groups


def test_representatives_are_one_of_each_component(spark, make):
    near = "the quick brown fox jumps over a lazy dog while seven old wizards brew potions near some river bank today"
    rows = [
        (1, near), (None, near), (None, "text of its own without any number at all"), (None, "and one more of these rows for good measure"), (7, "first text under seven is about clouds and rain"),
        (7, "second text under seven is about stones and sand"), (8, "second text under seven is about stones and sand"), (9, near + " x"), (9, near + " x"), (20, ""), (20, ""), (21, None), (None, None), (None, ""),
        (30, "twice the same row with words in it"), (30, "twice the same row with words in it"),
    ]
    docs = make(rows)
    out = nd.representatives(docs, k=4)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    ids, groups = brute_representatives(rows, 4)
    expected = sorted((min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values()), key=str)
    assert got == expected
    assert len(got) == len(ids) and {r[0] for r in got} == {1, 7, 20, 21, 30, None}
    assert sum(r[0] is None for r in got) == 4
    seen = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in nd.near_dedup(docs, k=4).collect()), key=str)
    assert sorted(seen, key=str) == sorted([(1, 1, True), (None, 1, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 1, False), (9, 1, False), (20, 20, True), (20, 20, True), (21, 21, True), (None, None, True), (None, None, True), (30, 30, True), (30, 30, True)], key=str)
    assert nd.representatives(make([])).collect() == []


def test_one_doc_id_with_two_texts_finds_near_copies_of_each(spark, make):
    one, two = " ".join(f"alpha{i}" for i in range(40)), " ".join(f"beta{i}" for i in range(40))
    rows = [(1, one), (1, two), (5, one + " end"), (6, two + " end"), (2, one + "  end"), (3, two)]
    got = sorted((r["doc_id"], r["component_id"]) for r in nd.near_dedup(make(rows), k=4).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (6, 1)]
    kept = sorted((r["doc_id"], r["text"]) for r in nd.representatives(make(rows), k=4).collect())
    assert kept == [(1, one), (1, two)]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
