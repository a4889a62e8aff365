"""Token counts, token files, Simple-8b and packing against the tokenizers library."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwell.llm import token_count
from tarnwell.llm.packing import assigned, packed
from tarnwell.llm.simple8b import pack, unpack
from tarnwell.llm.token_count import Counter, token_counts, whole_tokens
from tarnwell.llm.token_file import read_token_file, write_token_file
from tarnwell.llm.token_model import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", " ", "a", "B", "é", "1", "²", "!", "-", "<|endoftext|>", "<|", "中文", "🙂", "́", "Ᲊ", "\x1c", "　", "\r\n"]
DOCS = [(3, "Hello world's best <|endoftext|> text"), (1, None), (2, ""), (7, " \n\n x" * 900), (5, "a" * 5000), (5, "a" * 5000), (None, "no id"), (9, "The cat sat. " * 700)]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(exclude_categories=["Cs"])), max_size=12).map("".join))
def test_encoder_is_the_library(text):
    got, at = ENCODER.encode([text, text])
    assert got[: at[1]].tolist() == got[at[1] :].tolist() == ids(text)
    assert COUNTER.counts([text]).tolist() == [len(ids(text))]


ENCODER, COUNTER = Encoder(PATH), Counter(PATH, whole_tokens(PATH))


def test_whole_tokens_are_proven():
    assert 45_000 < len(whole_tokens(PATH)) <= 50_256


def test_other_vocabulary_goes_text_by_text():
    path = public_tokenizers.path("word_bpe_49k.json")
    other, library = Encoder(path), Tokenizer.from_file(path)
    got, at = other.encode(["Some words", "", "More of them!"])
    assert not other.fast
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in ("Some words", "", "More of them!")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=1200))
def test_simple8b_round_trip(values):
    values = np.array(values, np.uint64)
    words, starts, escapes = pack(values)
    assert unpack(words, starts, escapes, len(values)).tolist() == values.tolist()


def test_simple8b_packs_zeros_and_small_values():
    assert len(pack(np.zeros(1024, np.uint64))[0]) == 5
    assert len(pack(np.full(1024, 3, np.uint64))[0]) == 35


def test_token_counts(spark, make):
    got = sorted(map(tuple, token_counts(make(DOCS), PATH).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for d, t in DOCS), key=str)
    assert token_counts(make([]), PATH).collect() == []


def test_token_file(spark, make, tmp_path):
    path = str(tmp_path / uuid.uuid4().hex)
    write_token_file(make(DOCS), path, PATH)
    expected, start = [], 0
    for d, t in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = np.array([*ids(t), 2], "<u4")
        expected.append((d, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, read_token_file(spark, path).collect()), key=str) == sorted(expected, key=str)
    write_token_file(make([]), path + "-empty", PATH)
    assert read_token_file(spark, path + "-empty").collect() == []


def check_packing(rows, docs, capacity=1024):
    whole = sorted((d, [*ids(t), 0]) for d, t in docs)
    sequences, parts = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"], r["ids_crc32"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for (d, n), own in parts.items():
        tokens = next(np.array(t, "<u4") for e, t in whole if e == d and len(t) == n)
        assert sum(length for _, length, _ in own) % n == 0
        for start, length, crc in own:
            assert zlib.crc32(tokens[start : start + length].tobytes()) == crc
    total = sum(len(t) for _, t in whole)
    assert sum(r["length"] for r in rows) == total
    return len(sequences) * capacity - total


def test_packing(spark, make):
    docs = [(d if d is not None else -1, t) for d, t in DOCS]
    padding = check_packing(packed(make(docs), PATH).collect(), docs)
    assert padding < 1024
    assert packed(make([]), PATH).collect() == []
    rows = packed(make(docs), PATH, with_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_packing_keeps_rows_without_an_id(spark, make):
    docs = [(None, "same " * 30), (None, "same " * 30), (None, None), (1, "word " * 3000), (1, "word " * 3000)]
    rows = packed(make(docs), PATH).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) + 1 for _, t in docs)
    assert sum(r["start"] == 0 for r in rows) == len(docs) and sum(r["doc_id"] is None for r in rows) >= 3
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:], strict=False))


def test_rests_go_to_the_cheapest_sequence_with_room():
    rnd = random.Random(4)
    for _ in range(50):
        lengths = np.array([rnd.randint(1, 1023) for _ in range(rnd.randint(1, 60))], np.int64)
        out = assigned(lengths, 1024)
        n = -(-int(lengths.sum()) // 1024)
        cost, room, seen = [0.0] * n, [1024] * n, {}
        for i, start, length, to, offset in out:
            assert 1024 - room[to] == offset and seen.get(i, 0) == start
            fitting = [j for j in range(n) if room[j] >= lengths[i] - start]
            if fitting:
                assert length == lengths[i] - start and (start or cost[to] == min(cost[j] for j in fitting))
            else:
                assert room[to] == max(room) and length == room[to]
            room[to] -= length
            cost[to] += length + length * length / 512
            seen[i] = start + length
        assert min(room) >= 0 and all(seen[i] == k for i, k in enumerate(lengths))
        first = [next(k for k, o in enumerate(out) if o[0] == i) for i in np.argsort(-lengths, kind="stable")]
        assert first == sorted(first)
    assert assigned(np.zeros(0, np.int64), 1024) == []


def test_long_words_that_polynomials_confuse():
    """Two words of two letters in Thue-Morse order and its complement hash alike under any polynomial modulo 2^64."""
    own, count = Encoder(PATH), Counter(PATH, whole_tokens(PATH))
    for a, b in ("ab", "th", "eq"):
        for n in (1024, 2048, 4096):
            word = a
            while len(word) < n:
                word += word.translate(str.maketrans(a + b, b + a))
            texts = [word, word.translate(str.maketrans(a + b, b + a)), word]
            got, at = own.encode(texts)
            assert [got[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [ids(t) for t in texts]
            assert count.counts(texts).tolist() == [len(ids(t)) for t in texts]


def test_workers_start_afresh_when_they_know_too_much(monkeypatch):
    own, count = Encoder(PATH), Counter(PATH, whole_tokens(PATH)[:50])
    own.known.most = 40
    monkeypatch.setattr(token_count, "MOST_KNOWN", 60)
    rnd = random.Random(9)
    for _ in range(30):
        texts = [" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) + str(rnd.randrange(50)) for _ in range(12)) for _ in range(3)]
        got, at = own.encode(texts)
        assert [got[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == [ids(t) for t in texts]
        assert count.counts(texts).tolist() == [len(ids(t)) for t in texts]
