"""Chat formatting and fingerprints: exact round trips and brute force."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwell.llm import chat_format as cf
from tarnwell.llm import fingerprint as fp
from tarnwell.llm.queries import CONTROL, op4_chat_format

TURNS = [
    (1, 1, "user", "hi"), (1, 2, "assistant", "yo <|im_end|>\n<|im_start|>user\n\\s \\p \\n"), (1, 3, "user", "bye"), (1, 4, "assistant", None), (1, 5, "user", "tail"),
    (2, 2, "assistant", "second"), (2, 1, "system\nrole\\n", "first"), (3, 1, "user", None), (4, 1, None, "x"), (4, 1, "assistant", "tie"), (4, None, "user", "null turn"),
    (5, 1, "assistant", "é🙂" * 20_000), (6, 1, "assistant", "same"), (6, 1, "assistant", "same"), (None, 1, "assistant", "lost"),
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        told = "".join(x for _, r, x in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), len(told), sha(told))
    return out


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({"t": F.lit(1), "example": F.lit("x"), "head": F.lit("x")})


def test_round_trip(spark):
    got = {r["conv_id"]: tuple(r)[1:5] for r in cf.read_back(cf.chat_examples(conversations(spark, TURNS))).collect()}
    assert got == expected(TURNS)
    assert cf.read_back(cf.chat_examples(conversations(spark, []))).collect() == []


def test_each_assistant_turn_is_an_example(spark):
    rows = cf.chat_examples(conversations(spark, TURNS)).where("conv_id = 1").orderBy("example").collect()
    assert [r["loss_end"] > 0 for r in rows] == [True, True, False]
    for r in rows[:2]:
        assert r["text"][: r["loss_start"]].endswith("<|im_start|>assistant\n") and r["text"][r["loss_end"] :] == "<|im_end|>\n"
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[2]["text"].startswith(rows[1]["text"])
    assert rows[0]["text"].count("<|im_start|>") == 2


def test_control_conversation(spark):
    row = op4_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    assert row["n_turns"] == 2 and row["loss_chars"] == len(CONTROL) and row["loss_sha256"] == hashlib.sha256(CONTROL.encode()).hexdigest()


def edited(rows):
    rows = sorted(((d if d is not None else -(2**63), t or "") for d, t in rows))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return sorted(out)


DOCS = [(4, "one two. three\nfour"), (1, None), (9, "é🙂x" * 9), (2, ""), (6, "a\nb\nc"), (7, "c\n\na\nb"), (5, "w " * 40_000), (5, "w " * 40_000), (None, "none"), (12, "one two. three\nfour")]


@pytest.mark.parametrize(("ranges", "fan"), [(1, 8), (3, 8), (50, 8), (16, 2)])
def test_edited_texts(spark, make, ranges, fan):
    rows = fp.fingerprints(make(DOCS), ranges, fan).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["n_chars"], r["edited_sha256"]) for r in rows) == edited(DOCS)
    prints = {}
    for r in rows:
        prints.setdefault(r["fingerprint"], []).append(r["doc_id"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert sorted(sorted(v) for v in prints.values() if len(v) > 1) == [[1, 2], [4, 12], [5, 5], [6, 7]]
    near = {r["doc_id"]: r["near_next"] for r in rows}
    assert near[6] == 1.0 and near[1] == 1.0


def test_empty_and_single(spark, make):
    assert fp.fingerprints(make([])).collect() == []
    row = fp.fingerprints(make([(1, "abcd")])).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


def printed(df, *texts):
    """(i, f<text>...): the fingerprints of the text columns."""
    df, out = df.withColumn("i", F.monotonically_increasing_id()).cache(), None
    for c in texts:
        own = fp.with_fingerprint(df, c, f"f{c}", ["i"])
        out = own if out is None else out.join(own, "i")
    return out


def test_fingerprints_are_sums_of_hashed_bits(spark, make):
    """Fingerprints from their definition, in Python but for xxhash64."""
    texts = ["one two. three\nfour\n\n \nfour", "a b c d e f g h i j k. l\tm!\nn", "é🙂 x", ""]
    lines = [[p for p in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", p)] for t in texts]
    units = [re.findall(fp.UNITS, t) for t in texts]
    strings = sorted({v for own in lines + units for v in own})
    seeds = [*range(fp.WIDE), *fp.SEEDS]
    hashed = {r["v"]: [x & (1 << 64) - 1 for x in r["h"]] for r in spark.createDataFrame([(v,) for v in strings], "v string").select("v", F.array(*[F.xxhash64(F.lit(s), "v") for s in seeds]).alias("h")).collect()}
    got = {r["doc_id"]: r["fingerprint"] for r in fp.fingerprints(make(list(enumerate(texts)))).collect()}
    for i in range(len(texts)):
        wide = [sum(hashed[v][k] & fp.WIDE_MASK for v in lines[i]) % (1 << 62) for k in range(fp.WIDE)]
        bits = [[sum(hashed[v][fp.WIDE + s] >> j & 1 for v in units[i]) for j in range(64)] for s in range(len(fp.SEEDS))]
        packed = [own[j] + (own[j + 32] << 32) for own in bits for j in range(32)]
        assert got[i] == "".join(f"{x:016x}" for x in [*wide, len(units[i]), *packed])


def test_each_lane_hashes_the_paragraph_under_a_seed_of_its_own(spark):
    lines = ["one paragraph", "é🙂", "x" * 100]
    df = spark.createDataFrame([(v,) for v in lines], "v string")
    seeds = [*range(fp.WIDE), *fp.SEEDS]
    own = df.select("v", F.array(*[F.xxhash64(F.lit(s)) for s in seeds]).alias("seed"), fp._wide(F.col("v")).alias("lanes")).collect()
    for r in own:
        assert len(set(r["seed"])) == len(seeds)
        assert r["lanes"] == [xxhash.xxh64_intdigest(r["v"].encode(), s & (1 << 64) - 1) & fp.WIDE_MASK for s in r["seed"][: fp.WIDE]]


def test_paragraphs_are_added_and_removed(spark):
    df = spark.createDataFrame([("p one. and more\np two", "p three\n", "p three\np two\np one. and more")], "a string, b string, ab string")
    row = printed(df, *df.columns).select((fp.added(F.col("fa"), F.col("fb")) == F.col("fab")).alias("add"), (fp.removed(F.col("fab"), F.col("fb")) == F.col("fa")).alias("cut"), (F.col("fa") == F.col("fb")).alias("same")).first()
    assert row["add"] and row["cut"] and not row["same"]


def test_likeness_follows_the_shared_part(spark):
    line = lambda i: f"sentence number {i} talks of thing {i * 7} and {i * 13}."
    rows = [("\n".join(map(line, range(40))), "\n".join(map(line, range(40 - s, 80 - s)))) for s in (40, 20, 0)]
    df = printed(spark.createDataFrame(rows, "a string, b string"), "a", "b").orderBy("i")
    df = df.withColumns({"sa": fp.signed(F.col("fa")), "sb": fp.signed(F.col("fb"))})
    got = [r[0] for r in df.select(fp.likeness(F.col("fa"), F.col("fb"), F.col("sa"), F.col("sb"))).collect()]
    assert got[0] == 1.0 and abs(got[1] - 0.5) < 0.3 and got[2] < 0.3
