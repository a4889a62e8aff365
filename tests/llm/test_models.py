"""Language identification and toxicity: brute-force scores and held-out accuracy."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import language_id as li
from tarnwell.llm import textscan as ts
from tarnwell.llm import toxicity as tox
from tarnwell.llm.common import SHARES, in_share

DATA = "/root/testdata/sf0.001"


def marked(*words):
    own = [li.WORD_START + w for w in words]
    sizes = np.array([len(w) for w in own])
    return li.Words(np.array([ord(c) for w in own for c in w], np.uint32), np.cumsum(sizes) - sizes, sizes)


def segmentations(text, pieces):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        head = text[:n]
        if head in pieces or n == 1:
            for rest in segmentations(text[n:], pieces):
                yield [head, *rest]


def test_forward_pass_sums_all_segmentations():
    pieces = ["a", "ab", "abc", "b", "bc", "c", "▁", "▁a", "▁ab"]
    p = np.append(np.linspace(0.05, 0.2, len(pieces)), li.RARE)[:, None] * np.array([[1.0, 0.5]])
    lattice = li.Lattice(pieces)
    place = {x: i for i, x in enumerate(pieces)}
    for word in ("abc", "abcabc", "xab", "", "cab"):
        words = marked(word)
        got = lattice.forward(words, p)[0][0]
        for k in range(2):
            total = sum(math.prod(p[place.get(s, -1), k] for s in cut) for cut in segmentations(li.WORD_START + word, place))
            assert got[k] == pytest.approx(math.log(total))
        expected = lattice.expected(words, np.array([2.0]), np.array([1]), p)
        cuts = list(segmentations(li.WORD_START + word, place))
        weights = [math.prod(p[place.get(s, -1), 1] for s in cut) for cut in cuts]
        assert expected.sum() == pytest.approx(2 * sum(w * len(c) for w, c in zip(weights, cuts, strict=True)) / sum(weights))
        assert expected[:, 0].sum() == 0


def test_words_of_many_lengths_are_summed_together():
    pieces = ["a", "ab", "aba", "b", "▁", "▁a"]
    p = np.append(np.linspace(0.05, 0.2, len(pieces)), li.RARE)[:, None] * np.array([[1.0, 0.7, 1e-5]])
    lattice = li.Lattice(pieces)
    words = ["ab" * 4, "abaab", "ab", "b", ""]
    got = lattice.forward(marked(*words), p)[0]
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx(lattice.forward(marked(w), p)[0][0])
    whole = lattice.expected(marked(*words), np.arange(1.0, 6), np.array([0, 1, 2, 0, 1]), p)
    parts = sum(lattice.expected(marked(w), np.array([i + 1.0]), np.array([k]), p) for i, (w, k) in enumerate(zip(words, (0, 1, 2, 0, 1), strict=True)))
    assert whole == pytest.approx(parts)


def test_a_long_run_is_summed_whole():
    """A run of 3,000 letters against the forward recurrence in logarithms, without any cut in it."""
    pieces = ["a", "ab", "ba", "aab", "b", "▁", "▁a"]
    p = np.append(np.linspace(0.05, 0.2, len(pieces)), li.RARE)[:, None]
    word = ("aabab" * 600)[:3000] + "c"
    text, place = li.WORD_START + word, {x: i for i, x in enumerate(pieces)}
    logs = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for n in range(1, 4):
            if i + n <= len(text) and (text[i : i + n] in place or n == 1):
                logs[i + n] = np.logaddexp(logs[i + n], logs[i] + math.log(p[place.get(text[i : i + n], -1), 0]))
    assert li.Lattice(pieces).forward(marked(word), p)[0][0, 0] == pytest.approx(logs[-1])
    assert np.isfinite(li.Lattice(pieces).expected(marked(word), np.ones(1), np.zeros(1, int), p)).all()


def test_predictions_are_those_of_the_forward_sums(spark, make):
    """Each prediction from the word sums of its text alone, one text and word at a time."""
    pieces = ["▁", "▁a", "a", "b", "ab", "c"]
    p = np.array([[0.3, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.3], [0.2, 0.2], [0.1, 0.1], [li.RARE, li.RARE]])
    model = li.Model(pieces, ["x", "y"], p)
    rows = [(i, t) for i, t in enumerate(["ab ab c", "bb b", "a-ab1c", "Q zz", "ab" * 40, "", None, "12"])]
    lattice = li.Lattice(pieces)
    for r in li.language_id(make(rows), model).collect():
        words = "".join(c if c.isalpha() else " " for c in (dict(rows)[r["doc_id"]] or "").lower()).split()
        total = sum((lattice.forward(marked(w), p)[0][0] for w in words), np.zeros(2))
        assert r["lang_pred"] == ("xy"[int(total.argmax())] if words else "und")
        assert r["score"] == pytest.approx(1 / np.exp(total - total.max()).sum() if words else 0.0, abs=1e-6)


def test_language_id(spark, make):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = li.learn(docs, public_tokenizers.path("piece_bpe_32k.model"), most_documents=60, rounds=2)
    rows = li.language_id(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    odd = [(1, None), (2, ""), (3, "123 !!"), (None, "the thing that was"), (5, "of the " * 30_000), (5, "of the"), (6, "x" * 5000), (7, "́́")]
    got = {(r["doc_id"], r["lang_pred"]) for r in li.language_id(make(odd), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (5, "en"), (None, "en")} <= got
    assert all(0 <= r["score"] <= 1 for r in li.language_id(make(odd), model).collect())
    assert li.language_id(make([]), model).collect() == []
    none = li.learn(make(odd).withColumn("lang", F.lit(None).cast("string")), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in li.language_id(make(odd), none).collect()} == {"und"}


def test_word_spans_keep_long_runs():
    _, starts, ends, document, letters = li.word_spans(["ab c", "x" * 60, "", "1"])
    assert (ends - starts).tolist() == [2, 1, 60] and document.tolist() == [0, 0, 1] and letters.tolist() == [True, True, False, False]


def test_hash_index_and_spans():
    rnd = np.random.default_rng(2)
    keys = np.unique(rnd.integers(1, 2**63, 50_000, dtype=np.uint64))
    index = ts.HashIndex(4)
    for part in np.array_split(keys, 7):
        index.put(part, (part % np.uint64(1000)).astype(np.int32))
    assert (index.get(keys) == (keys % np.uint64(1000)).astype(np.int32)).all()
    assert (index.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    codes = ts.code_points(["abcab", "ab"])
    h = ts.span_hashes(codes, np.array([0, 3, 6, 0]), np.array([2, 5, 8, 3]))
    assert h[0] == h[1] == h[2] != h[3]


def toxic_corpus():
    bad, good = ["scum", "moron"], ["cloud", "river", "stone", "field", "house", "green", "quiet"]
    rnd = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(400):
        sentences = [" ".join(rnd.choice(good, 6)) for _ in range(rnd.integers(1, 9))]
        toxic = i % 4 == 0
        if toxic:
            at = rnd.integers(len(sentences))
            sentences[at] += " " + bad[i // 4 % 2] + ["", "s", "ly"][i // 8 % 3]
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark, make):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit(make(docs), frame)
    truth = dict(labels)
    rows = tox.toxicity_scores(make(docs), model).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    found = {r["doc_id"]: r["unit"] for r in tox.offending(make(docs), model).collect()}
    assert set(found) <= {d for d, y in truth.items() if y}
    assert all("scum" in u or "moron" in u for u in found.values()) and len(found) > 80
    odd = [(1, None), (2, ""), (None, "quiet river"), (3, "field " * 50_000), (3, "field"), (4, "scum " * 50_000)]
    got = tox.toxicity_scores(make(odd), model).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and {r["doc_id"] for r in got if r["predicted"]} == {4}
    assert tox.toxicity_scores(make([]), model).collect() == []
    clean = tox.clean_documents(make(docs), frame)
    assert clean.columns == make(docs).columns and clean.count() == sum(r["predicted"] == 0 for r in rows)


def test_noisy_or_is_the_product(spark):
    docs, _ = toxic_corpus()
    texts = [t for _, t in docs[:20]] + [""]
    words = tox.words_of(texts)
    keys = np.unique(words.features[0])
    model = tox.Model(keys, np.linspace(-1, 1, len(keys)), -2.0, 0.05)
    z = model.unit_scores(words, model.index())
    got = model.scores(words, z)
    for d in range(len(texts)):
        units = [1 / (1 + math.exp(-x)) for x, owner in zip(z, words.unit_document, strict=True) if owner == d]
        assert got[d] == pytest.approx(1 - 0.95 * math.prod(1 - u for u in units))
    assert got[-1] == pytest.approx(0.05)


def test_offsets_are_those_of_the_text_as_it_is(spark, make):
    model = tox.Model(tox.words_of(["scum"]).features[0], np.array([9.0]), -2.0, 0.0)
    rows = [(1, "İİİ scum here. Fine"), (2, "ok. SCUM!"), (3, None)]
    got = {r["doc_id"]: (r["start"], r["end"], r["unit"]) for r in tox.offending(make(rows), model).collect()}
    assert got == {1: (0, 13, "İİİ scum here"), 2: (4, 8, "SCUM")}


def test_the_sample_is_bounded_by_bytes(spark, make):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    size = sum(len(t) for _, t in docs)
    drawn = tox.sampled(make(docs), frame, 10_000, size // 4)
    assert 0.1 * size < drawn.agg(F.sum(F.octet_length("text"))).first()[0] < 0.45 * size
    assert 50 < tox.sampled(make(docs), frame, 100, size).count() < 160
    assert tox.sampled(make(docs), frame, 400, size).count() == 400
    assert tox.sampled(make([(1, "x" * (tox.LONGEST + 1)), (2, None)]), frame, 400, size).count() == 1


def test_tiny_shares_draw_or_raise(spark, make):
    """A share of 2^-30 of a table, as a billion times the bound would give: never a model of nothing."""
    texts = [(i, f"some words {i}") for i in range(60)]
    docs = make(texts).withColumn("lang", F.lit("en"))
    with pytest.raises(ValueError, match="no document was drawn"):
        li.learn(docs, public_tokenizers.path("piece_bpe_32k.model"), most_documents=60 / 2**30)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    with pytest.raises(ValueError, match="no document of one label"):
        tox.fit(make(texts), labels, most_labels=60 / 2**30)
    keys = spark.range(1 << 20).withColumn("hit", in_share(F.col("id"), F.lit(SHARES >> 12)))
    assert 150 < keys.where("hit").count() < 370
    assert spark.range(1000).where(in_share(F.col("id"), F.lit(SHARES))).count() == 1000


def test_fit_without_a_chosen_word(spark, make):
    """Labels that no word explains leave a model without weights."""
    docs = [(i, "same words in every text") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = tox.fit(make(docs), labels)
    assert len(model.keys) == 0
    assert all(0 <= r["score"] <= 1 for r in tox.toxicity_scores(make([*docs, (None, None)]), model).collect())


def test_clean_documents_keep_nulls_and_empty_tables(spark, make):
    docs, labels = toxic_corpus()
    frame = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    odd = make([*docs, (None, None), (900, ""), (None, "quiet river")])
    kept = tox.clean_documents(odd, frame)
    assert sum(r["doc_id"] is None for r in kept.collect()) == 2 and kept.where("doc_id = 900").count() == 1
    assert tox.clean_documents(make([]), frame).collect() == []



def test_one_kind_of_label_gives_its_share(spark, make):
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    model = tox.fit(make([(i, "word") for i in range(20)]), labels)
    assert tox.toxicity_scores(make([(1, "word")]), model).first()["score"] == 0.0
    none = tox.fit(make([(1, "word")]), labels.limit(0))
    assert tox.toxicity_scores(make([(1, "word")]), none).first()["score"] == 0.0
