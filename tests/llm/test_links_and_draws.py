"""SimHash, alignment and resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tarnwell.llm import alignment as al
from tarnwell.llm import resampling as rs
from tarnwell.llm import simhash as sh
from tarnwell.llm.queries import queries

from .conftest import WORDS, rows_of

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one two"), (6, "One Two  three\x0bfour"), (7, "one two three four"), (7, "one two three four"), (None, "one two three four"), (None, None), (8, "Été Ñandú naïve ÀÉ Über"), (9, "x" * 70_000), (10, "a b " * 30_000)]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- SimHash


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """marks: (doc_id, fingerprint) -> the least doc_id that links reach, for each."""
    parent = list(range(len(marks)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(marks):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(marks))]


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("most", [1024, 3])
def test_simhash_dedup(spark, make, k, most):
    rng = random.Random(k)
    rows = list(ODD)
    for i in range(60):
        base = rng.choices(WORDS, k=rng.randint(2, 120))
        for j in range(rng.choice([1, 1, 6])):
            words = [w if rng.random() > 0.02 else rng.choice(WORDS) for w in base]
            rows.append((100 + 10 * i + j, " ".join(words)))
    marks = [(d, brute_fingerprint(t, k)) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(marks, brute_components(marks), strict=True)), key=str)
    assert rows_of(sh.simhash_dedup(make(rows), k=k, most=most)) == want
    assert sh.simhash_dedup(make([]), k=k).collect() == []


@pytest.mark.parametrize("most", [1024, 30, 2])
def test_no_link_is_lost_in_dense_buckets(spark, most):
    """Hundreds of fingerprints within a few bits of each other, over all ways of splitting large buckets."""
    rng = random.Random(most)
    values = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(90):
            x = base
            for b in rng.choices(range(64), k=rng.randint(0, 4)):
                x ^= 1 << b
            values.add(x)
    for start in range(3):  # chains: all within one segment
        base, by = rng.getrandbits(64), sum(sh.WIDTHS[:start])
        values |= {base ^ (x << 64 - by - sh.WIDTHS[start]) for x in range(40)}
    values |= {0, 1, 2, (1 << 64) - 1, (1 << 63) - 1}
    values = sorted(values)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    df = spark.createDataFrame([(f,) for f in signed], "f long")
    parent = {f: f for f in signed}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in sh.links(df, most).collect():
        parent[root(a)] = root(b)
    got, want = {}, {}
    for i, c in zip(signed, brute_components(list(enumerate(values))), strict=True):
        got.setdefault(root(i), []).append(i)
        want.setdefault(c, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_simhash_of_pieces():
    text = " ".join(random.Random(1).choices(WORDS, k=3000))
    data = text.encode().translate(sh.TABLE)
    for k in (1, 3, 5):
        assert sh.simhash(data, k, piece=64) == sh.simhash(data, k) == brute_fingerprint(text, k)
    assert sh.simhash(b"a b", 3, piece=1) == brute_fingerprint("a b", 3)
    assert [sh.budget(n) for n in (1, 2, 3)] == [0, 1, 2]


# ---- alignment


def brute_alignment(rows):
    """Token by token, with the libraries on whole texts."""
    a_lib, b_lib = Tokenizer.from_file(BYTE), SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    back = {c: b for b, c in al.byte_alphabet().items()}
    found = []
    for d, t in rows:
        a = [(i, bytes(back[c] for c in a_lib.id_to_token(i))) for i in a_lib.encode(f" {t}", add_special_tokens=False).ids] if t else []
        b = []
        for i in b_lib.encode(t) if t else []:
            name = b_lib.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) and b_lib.is_byte(i) else name.replace("▁", " ").encode()))
        if not t or any(b"".join(x for _, x in s) != f" {t}".encode() for s in (a, b)):
            a, b = [], []
        spans = []
        for s in (a, b):
            at, own = 0, []
            for i, x in s:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]] if len(a) < 500 else sweep(*spans)
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, _, z in s if low < z <= e) for s in spans) if len(a) < 500 else None)
            low = e
        found.append((d, spans, links, groups, ends))
    counts = Counter(p for *_, links, _, _ in found for p in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(n, best.get(x, 0))
    out = []
    for d, spans, links, groups, ends in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else "" if not groups else None
        out.append((d, len(spans[0]), len(spans[1]), len(ends), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return out


def sweep(a, b):
    links, j = [], 0
    for i, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            links.append((i, b[k][0]))
            k += 1
    return links


TEXTS = [*ODD, (20, "<|endoftext|> is plain <s> text </s> <unk> <0x0A>"), (21, "a▁b"), (22, "日本語 テキスト 🙂🙃 ﷽"), (23, "  two  blanks \n\n lines\t tabs\r\n"), (24, " "), (25, "\x00\x01 control"), (26, "it's they'll 123,456.789"), (27, "x y　z​w")]


@pytest.mark.parametrize("most", [500_000, 5])
def test_alignment(spark, make, most):
    rng = random.Random(5)
    rows = TEXTS + [(100 + i, " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))) for i in range(30)]
    got = {i: r for i, r in enumerate(rows_of(al.alignment(make(rows), BYTE, PIECE, most=most)))}
    want = sorted(brute_alignment(rows), key=str)
    assert len(got) == len(want)
    for i, w in enumerate(want):
        assert got[i][:7] == w[:7]
        assert w[7] is None or got[i][7] == w[7]
    assert al.alignment(make([]), BYTE, PIECE).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_pieces_by_words_are_the_librarys(texts):
    own = al.side(PIECE)
    assert own.fast
    ids, at = own.encode(texts)
    for i, t in enumerate(texts):
        if t:
            assert ids[at[i] : at[i + 1]].tolist() == own.library.encode(t)


def test_overlaps_in_chunks(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices([*WORDS, "日本", "é"], k=400)) for _ in range(3)]
    a, b = al.side(BYTE), al.side(PIECE)
    right = np.ones(3, bool)
    x, y = al.Placed(a.spelling, *a.encode(texts), right), al.Placed(b.spelling, *b.encode(texts), right)
    same = np.intersect1d(x.end, y.end)
    whole = al.overlaps(x, y, same)
    for chunk in (1, 7, 100):
        part = al.overlaps(x, y, same, chunk)
        assert all((p == w).all() for p, w in zip(part, whole, strict=True))
    assert len(whole[0]) == sum(max(p, q) < min(r, s) for p, r in zip(x.start, x.end, strict=True) for q, s in zip(y.start, y.end, strict=True))


# ---- resampling


def brute_resample(rows, target, n, buckets, least, percent, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(words), [" ".join(words[i : i + j]) for j in range(1, n + 1) for i in range(len(words) - j + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(d, *features(t)) for d, t in rows]
    s, t = Counter(bucket(f) for *_, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    scored = []
    for d, n_words, fs in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(f)) for f in fs)
        scored.append((d, n_words, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2]))
    drawn = percent * len(enough) // 100
    out = [(x[0], *x[2:], i + 1 if i < drawn else None) for i, x in enumerate(enough)]
    return sorted(out + [(x[0], *x[2:], None) for x in scored if x[1] < least], key=str)


@pytest.mark.parametrize(("n", "buckets", "percent"), [(1, 10_000, 10), (1, 50, 60), (3, 300, 100)])
def test_resample(spark, make, n, buckets, percent):
    rng = random.Random(n)
    rows = ODD + [(100 + i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for i in range(80)]
    rows += [(500, "same words " * 15)] * 3 + [(None, "no id here " * 10)] * 2
    target = [" ".join(rng.choices(WORDS[:6], k=40)), None, "", "Été, 42!"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = rows_of(rs.resample(make(rows), bench, n=n, buckets=buckets, percent=percent))
    assert got == brute_resample(rows, target, n, buckets, 20, percent, 2024)
    assert rs.resample(make([]), bench).collect() == []


def test_runs_over_pieces():
    data = " ".join(random.Random(3).choices(WORDS, k=500)).encode().translate(rs.TABLE)
    for n in (1, 2, 4):
        whole = [c for _, f in rs.run_hashes(data, n) for c in f]
        cut = [c for _, f in rs.run_hashes(data, n, piece=40) for c in f]
        assert Counter(whole) == Counter(cut)


def test_the_queries_themselves(spark):
    """The registered queries over the smallest tables, whole, against brute force."""
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{at}/benchmark.parquet").select("text").collect()]
    marks = [(d, brute_fingerprint(t, 3)) for d, t in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(marks, brute_components(marks), strict=True)), key=str)
    own = queries()
    assert rows_of(own["op11_simhash"](spark, at)) == want
    assert rows_of(own["op13_resampling"](spark, at)) == brute_resample(rows, target, 1, 10_000, 20, 10, 2024)
    got = rows_of(own["op12_alignment"](spark, at))
    for g, w in zip(got, sorted(brute_alignment(rows), key=str), strict=True):
        assert g[:7] == w[:7]
        assert w[7] is None or g[7] == w[7]
