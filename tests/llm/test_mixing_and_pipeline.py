"""Mixing against its definition, and the pipeline end to end on the smallest tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwell.llm import mixing as mx

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"s": F.lit(1), "at": F.lit(2), "block": F.lit("x"), "size": F.lit(-1)})


ROWS = [(i, "w%d " % i * (5 + i % 37), "abc"[i % 3] if i % 7 else None) for i in range(300)] + [(900, None, "a"), (901, "", None), (902, "big " * 9000, "b"), (903, "t u", "z"), (5, "w5 w5", "b"), (5, "w5 w5", "b")]


def plain_targets(sizes):
    weights, target, open_, rest = [(3, 1, 2)[i % 3] for i in range(len(sizes))], [0.0] * len(sizes), list(range(len(sizes))), 1.5 * sum(sizes)
    while True:
        share = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 2 * sizes[i]]
        for i in over or open_:
            target[i] = 2.0 * sizes[i] if over else share[i]
        if not over:
            return target
        rest, open_ = rest - sum(target[i] for i in over), [i for i in open_ if i not in over]
        if not open_:
            return target


def test_targets():
    for sizes in ([10, 1000, 20], [5], [100, 100, 100], [0, 50, 3, 3, 900, 1]):
        assert mx.targets(sizes) == pytest.approx(plain_targets(sizes))
    assert mx.targets([]) == [] and mx.targets([0, 0]) == [0.0, 0.0]


def test_mix(spark):
    docs = documents(spark, ROWS)
    per, mixture = mx.mix(docs, block_words=8)
    rows = per.collect()
    again = sorted((r["doc_id"], r["taken"]) for r in mx.mix(docs.repartition(3), block_words=8)[0].where("doc_id <> 5").collect())
    assert sorted((r["doc_id"], r["taken"]) for r in rows if r["doc_id"] != 5) == again
    size = {}
    for _, t, s in ROWS:
        size[s] = size.get(s, 0) + len(WORDS.findall(t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(names, plain_targets([size[s] for s in names]), strict=True))
    source = {}
    for d, _, s in ROWS:
        source.setdefault(d, s)
    taken = dict.fromkeys(names, 0)
    for r in rows:
        s = source[r["doc_id"]] if r["doc_id"] != 5 else next(x for x in names if size[x] == r["source_size"])
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 8 + 0.01 * target[s]
    assert len(rows) == len(ROWS)
    own = {(r["u"], r["epoch"], r["start"]) for r in mixture.collect()}
    assert len(own) == mixture.count()


def test_whole_texts_stay_and_parts_are_cut_at_words(spark):
    docs = documents(spark, ROWS).withColumn("n_chars", F.length("text").cast("long"))
    out = mx.mixed_documents(docs, block_words=8)
    assert out.columns == docs.columns
    texts, words = {}, {}
    for d, t, _ in ROWS:
        texts.setdefault(d, set()).add(t)
    for r in out.collect():
        assert any(r["text"] in (t or "") for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(WORDS.findall(r["text"]))
    per = {}
    for r in mx.mix(docs, block_words=8)[0].collect():
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + r["taken"]
    assert words == {d: n for d, n in per.items() if n}


def test_empty_mixes(spark):
    for rows in ([], [(1, None, None), (2, " ", "a")]):
        per, mixture = mx.mix(documents(spark, rows))
        assert per.count() == len(rows) and mixture.count() == 0
        assert mx.mixed_documents(documents(spark, rows)).count() == 0


def test_permutations_and_draws():
    for n in (1, 2, 3, 17, 1000, 4097):
        seen = [mx.permuted(np.arange(n), np.full(n, n), np.full(n, key)) for key in (1, 2)]
        assert all(sorted(s) == list(range(n)) for s in seen)
        assert n < 17 or (seen[0] != seen[1]).any()
    totals = [1000, 30, 0, 471]
    for groups, shards in ((1, 16), (3, 5), (1, 1)):
        draws = [mx.drawn(totals, groups, shards, i, 9) for i in range(groups * shards)]
        assert (sum(d[1] for d in draws) == totals).all()
        n = [d[1].sum() for d in draws]
        assert max(n) - min(n) <= 1 + len(totals)
        for a, b in zip(draws, draws[1:], strict=False):
            assert (a[0] + a[1] == b[0]).all()
    for a, b in zip(draws, draws[1:], strict=False):
        assert (a[0] + a[1] == b[0]).all()


def test_draws_of_billions_of_slots():
    totals = [2_000_000_000, 5, 1_300_000_000_001]
    groups, shards = mx.grouped(totals, 4096)
    assert groups * shards * 4096 >= sum(totals)
    for shard in (0, 1, shards - 1, shards, groups * shards // 2, groups * shards - 1):
        before, inside = mx.drawn(totals, groups, shards, shard, 7)
        assert 0 < inside.sum() <= 4096 and (before >= 0).all()
        after = mx.drawn(totals, groups, shards, shard + 1, 7)[0] if shard + 1 < groups * shards else np.array(totals)
        assert (before + inside == after).all()
        assert abs(inside[0] - inside.sum() * totals[0] / sum(totals)) < 40


def test_columns_of_any_name_and_rows_without_an_id(spark, make):
    rows = [(None, "same text here"), (None, "same text here"), (1, None), (2, "own words of two"), (None, "lone text")]
    docs = make(rows)
    out = mx.mixed_documents(docs)
    assert out.columns == docs.columns
    kept = [(r["doc_id"], r["text"], r["th"], r["_doc"], r["row"], r["n_chars"]) for r in out.collect()]
    assert {k[0] for k in kept} <= {None, 2} and all(k[2:5] == ("x", "x", "x") and k[5] == len(k[1]) for k in kept)
    per = mx.mix(docs)[0].collect()
    assert len(per) == len(rows) and sum(r["taken"] for r in per) == sum(len(k[1].split()) for k in kept)


def test_the_slots_are_not_broadcast(spark):
    plan = mx.mix(documents(spark, ROWS))[0]._jdf.queryExecution().toString()
    joined = [line for line in plan[plan.index("== Physical") :].splitlines() if "block" in line and "Join" in line]
    assert joined and all("SortMergeJoin" in line for line in joined)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, make, name):
    stage, data = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    empty = make([])
    assert stage(spark, empty, data).collect() == []
    rows = [(1, "a text of some words that nothing else says"), (1, "a text of some words that nothing else says"), (None, None), (None, "text without a number but with words"), (2, ""), (3, "w " * 20_000), (4, "other words of the fourth text here")]
    out = stage(spark, make(rows).withColumn("source", F.when(F.col("doc_id") > 2, "s")), data)
    got = {r["doc_id"] for r in out.collect()}
    assert out.columns == empty.columns if name != "packing" else "sequence_id" in out.columns
    assert got == ({1, 2, 3, 4, None} if name != "mixing" else {1, 3, 4, None}) or (name == "mixing" and got <= {1, 3, 4, None} and got)


def brute_pipeline_filters(rows, rejected):
    """doc_ids that toxicity, exact dedup and near-dedup keep, the plain way."""
    kept = [r for r in rows if r[0] not in rejected]
    first = {}
    for d, t in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (d, t))
    kept = sorted(first.values())
    from .test_dedup import brute_links

    return {d for d, (_, c) in brute_links(kept, 5).items() if d == c}


def test_stages_keep_what_the_definitions_keep(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, data).cache()
    left = stages["near_dedup"](spark, stages["exact_dedup"](spark, clean, data).cache(), data)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    rejected = {d for d, _ in rows} - {r["doc_id"] for r in clean.collect()}
    assert {r["doc_id"] for r in left.collect()} == brute_pipeline_filters(rows, rejected)


def test_pipeline(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs_in, docs = docs, stage(spark, docs, data)
        if name != "packing":
            assert docs.columns == docs_in.columns
        docs = docs.cache()
        counts[name] = docs.count()
    assert 150 < counts["toxicity"] < 200 and counts["near_dedup"] <= counts["exact_dedup"] <= counts["toxicity"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    run = corpus_pipeline.run(spark, data)
    assert run.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and run.count() > 100
