"""Mixing sources to target weights, in blocks of a fixed number of words.

1. The words of each source are laid end to end (documents in pseudorandom, repeatable order) and cut
   into blocks of ``block_words``.
2. The mix has as many slots of each source as its target asks for. Slots are dealt to output shards:
   each shard draws the counts of its sources from a multinomial that is conditional on the totals
   of its group of shards, by halving the range of shards again and again, so a shard can draw its
   own counts, and how many slots of each source lie before it, from the seed alone.
3. Slot r of a source takes block ``permutation(r mod blocks)`` of it, by a keyed permutation of the
   source's block indexes, another one for each epoch ``r div blocks``.
4. Slots and the parts of documents that lie in each block are joined by source and block index.

No source takes a block more than ``most`` times, so no document gives more than ``most`` times its
words. The table of sources (one row each, at most ``MOST_SOURCES``) goes to the driver; nothing else does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, in_rows, matched, named, stable, text_hash, without_repeats
from .textscan import mixed

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_SLOTS, BUCKET_ROWS = 64, 4096, 20_000
#: Slots of a group of shards: numpy draws from less than 10^9 at once.
GROUP_SLOTS = 1 << 28
#: Every shard draws a count for each source, so the table of sources must fit in a task; more are an error.
MOST_SOURCES = 100_000
_WORD = re.compile(WORD)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """What each source (in order) is to give: its share by weight of ``share`` times all words; what
    goes beyond ``most`` times its size is reshared by weight among the others until none is above.

    That fills the sources of the least size by weight first, so one pass in that order does it.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, total = [0.0] * len(sizes), share * sum(sizes), sum(w)
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i] / w[i]):
        out[i] = min(float(most * sizes[i]), rest * w[i] / total)
        rest, total = rest - out[i], total - w[i]
    return out


def grouped(totals: list[int], shard_slots: int, group_slots: int = GROUP_SLOTS) -> tuple[int, int]:
    """(groups, shards in each): the mix in groups of at most about ``group_slots`` slots."""
    groups = max(1, -(-sum(totals) // group_slots))
    most = max(sum(t * (g + 1) // groups - t * g // groups for t in totals) for g in {0, groups - 1, groups // 2}) + len(totals)
    return groups, max(1, -(-most // shard_slots))


def drawn(totals: list[int], groups: int, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source before this shard, slots of each source in it).

    A group gets its even share of each source's slots, to the slot; its shards draw theirs from the
    multinomial given the group's totals, halving the range of shards again and again.
    """
    group, shard = divmod(shard, shards)
    before = np.array([t * group // groups for t in totals], np.int64)
    inside = np.array([t * (group + 1) // groups for t in totals], np.int64) - before
    n, low, high = int(inside.sum()), 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        left = np.random.default_rng([seed, group, low, high]).multivariate_hypergeometric(inside, n * middle // shards - n * low // shards, method="marginals")
        if shard < middle:
            high, inside = middle, left
        else:
            low, before, inside = middle, before + left, inside - left
    return before, inside


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 at ``index``: a Feistel network, walked until inside."""
    half = ((np.maximum(np.ceil(np.log2(np.maximum(n, 2))), 2).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.astype(np.uint64), np.arange(len(index))
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(left):
        h, m, k = half[left], mask[left], key[left]
        a, b = out[left] >> h, out[left] & m
        for turn in range(4):
            a, b = b, a ^ (mixed(b ^ mixed(k + np.uint64(turn))) & m)
        out[left] = (a << h) | b
        left = left[out[left] >= n[left]]
    return out.astype(np.int64)


def source_table(sizes: DataFrame, block_words: int) -> pd.DataFrame:
    """One row per source that has words or not: source, size, target, blocks, slots; null source last."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: join small ones first")
    # code point order is the order of the UTF-8 bytes
    rows = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    out = pd.DataFrame({"source": [r["source"] for r in rows], "size": [int(r["size"]) for r in rows]})
    out["target"] = targets(out["size"].tolist())
    out["blocks"] = -(-out["size"] // block_words)
    out["slots"] = [min(MOST * b, round(t * b / s)) if s else 0 for t, b, s in zip(out["target"], out["blocks"], out["size"], strict=True)]
    return out


def as_rows(spark: SparkSession, table: pd.DataFrame) -> DataFrame:
    """The table of sources as a DataFrame, with their place ``s``."""
    rows = [(i, r["source"], int(r["size"]), float(r["target"])) for i, r in enumerate(table.to_dict("records"))]
    return spark.createDataFrame(rows, "s int, source string, source_size long, target double")


def laid_out(sizes: DataFrame, rows: int, seed: int) -> DataFrame:
    """``sizes`` with ``at``: the words of its source that lie before each document.

    Documents of a source are dealt by hash into buckets of about ``BUCKET_ROWS``; running totals are
    taken within a bucket and over the buckets of a source, so no task gets a whole source.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    # 64 buckets a source at least, so that a source of a third of all rows is spread
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(max(64, buckets))))
    own = Window.partitionBy("s", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "u").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = dealt.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
    return inside.join(base, ["s", "bucket"]).withColumn("at", F.col("base") + F.col("inside")).drop("base", "inside", "bucket")


def slots(spark: SparkSession, table: pd.DataFrame, seed: int) -> DataFrame:
    """The slots of the mix: shard, slot, s, epoch, block."""
    totals, blocks = table["slots"].tolist(), table["blocks"].to_numpy(np.int64)
    groups, shards = grouped(totals, SHARD_SLOTS) if sum(totals) else (0, 0)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                before, inside = drawn(totals, groups, shards, shard, seed)
                rng = np.random.default_rng([seed + 1, shard])
                s = np.repeat(np.arange(len(totals)), inside)
                rank = np.arange(len(s)) + np.repeat(before - np.cumsum(inside) + inside, inside)
                epoch = rank // np.maximum(blocks[s], 1)
                key = mixed((s * MOST + epoch + (seed << 20)).astype(np.uint64))
                block = permuted(rank - epoch * blocks[s], blocks[s], key)
                yield pd.DataFrame({"shard": shard, "slot": rng.permutation(len(s)), "s": s.astype(np.int32), "epoch": epoch.astype(np.int32), "block": block})

    return spark.range(groups * shards).mapInPandas(deal, "shard long, slot long, s int, epoch int, block long")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(per document: u, doc_id, size, source_size, target, taken; the mix: u, doc_id, th, size, shard, slot,
    epoch, start, length in words of the document).

    Needs doc_id, text and source; other columns are not read. A null text has no words; a null source
    is a source of its own, the last; repeated rows are documents of their own (``u`` tells rows
    apart). An empty table, or one without words, gives an empty mix.
    """
    spark = docs.sparkSession
    sizes = stable(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text")).alias("size"), text_hash().alias("th"), F.monotonically_increasing_id().alias("u")))
    rows = sizes.count()
    sources = source_table(sizes, block_words)
    if not len(sources):
        empty = sizes.select("u", "doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
        return empty, sizes.select("u", "doc_id", "th", "size", *[F.lit(0).cast("long").alias(c) for c in ("shard", "slot", "epoch", "start", "length")])
    # at most MOST_SOURCES rows
    sizes = matched(sizes, F.broadcast(as_rows(spark, sources)), ["source"]).drop("source")
    laid = laid_out(sizes.where("size > 0"), rows, seed)
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    parts = laid.select("u", "doc_id", "th", "s", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.lit(0), F.col("block") * block_words - F.col("at"))
    stop = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("at"))
    parts = parts.select("u", "doc_id", "th", "size", "s", "block", start.alias("start"), (stop - start).alias("length"))
    # both sides grow with the corpus, so neither may be broadcast, however small the range of shards looks
    mixture = parts.join(slots(spark, sources, seed).hint("merge"), ["s", "block"]).drop("s", "block")
    taken = mixture.groupBy("u").agg(F.sum("length").alias("taken"))
    per_document = sizes.join(taken, "u", "left").select("u", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return per_document, mixture


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """What the mix takes of ``docs``, as documents: for each epoch, each run of words that it takes
    without a gap is a row with the columns of its document, its own text and n_chars.

    A document taken whole keeps its text as it is; of others the text from the first to the last word
    of the run stays. Documents of which the mix takes nothing are left out, as are those without words.
    Repeated rows, and rows without a doc_id, are documents of their own. An empty table stays empty.
    """
    _, mixture = mix(docs, block_words, seed)
    own = Window.partitionBy("u", "epoch").orderBy("start")
    fresh = F.coalesce((F.lag(F.col("start") + F.col("length")).over(own) != F.col("start")).cast("int"), F.lit(1))
    runs = mixture.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("u", "doc_id", "th", "size", "epoch", "run").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    runs = runs.select("doc_id", "th", F.when(F.col("length") < F.col("size"), F.col("start")).alias("start"), "length")
    once = without_repeats(in_rows(docs, doc_id=F.col("doc_id").cast("long"), th=text_hash()), "doc_id", "th")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for text, start, length in zip(texts, starts, lengths, strict=True):
            if text is None:
                out.append(None)
                continue
            places = list(islice(_WORD.finditer(text), int(start), int(start + length)))
            out.append(text[places[0].start() : places[-1].end()])
        return pd.Series(out, dtype=object)

    taken = matched(runs, once, ["doc_id", "th"])
    part = F.when(F.col("start").isNotNull(), F.col("row.text"))
    taken = taken.withColumn("text", F.coalesce(cut(part, F.coalesce("start", F.lit(0)), "length"), F.col("row.text")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return taken.select(*[new.get(c, F.col(f"row.{named(c)}")).alias(c) for c in docs.columns])
