"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of white space became one space. Rows are combined
in three steps, and every step has the whole normalised text in its key, so a digest that two
texts share never merges them:

1. local: each task combines the equal texts that it reads (the partial aggregate);
2. salted: digests of hot groups are dealt over ``salts`` tasks and combined there;
3. global: the few winners of each hot group, one per salt, are combined.

A digest is hot if it has more than ``1 / hot_share`` of all rows, so at most ``hot_share``
digests are broadcast. All other groups are complete after step 2.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, in_rows, matched, small, stable, without_repeats


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def classes(texts: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """(d, n, keep_id, group_size) for each distinct text of ``texts`` (id, d, n); n only where the digest
    is hot, the others need it no more."""
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(salts))).otherwise(0)
    salted = texts.join(F.broadcast(hot), "d", "left").withColumn("salt", salt)
    winners = salted.groupBy("d", "salt", "n", "hot").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = stable(winners.withColumn("n", F.when(F.col("hot"), F.col("n"))))
    merged = winners.where("hot").groupBy("d", "n").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return winners.where("hot is null").select("d", "n", "keep_id", "group_size").unionByName(merged)


def of_digest(members: DataFrame, found: DataFrame, hot: DataFrame) -> DataFrame:
    """``members`` joined to what was ``found`` for their digest; hot digests, which are few, by a broadcast."""
    hot = F.broadcast(hot)
    rare = members.join(hot, "d", "left_anti").join(found.join(hot, "d", "left_anti"), "d")
    return rare.unionByName(members.join(F.broadcast(found.join(hot, "d", "left_semi")), "d"))


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, hot_share: int = 1000, salts: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not read. A null text
    counts as empty. Of equal texts the row with the smallest doc_id stays (a null doc_id only where
    the group has no other); of repeated rows with that doc_id exactly one stays. An empty table
    gives an empty result. ``digest`` groups texts before they are compared; texts that share a
    digest and differ are told apart by their content.
    """
    texts = docs.select(F.col("doc_id").alias("id"), normalised(F.col("text")).alias("n"))
    texts = texts.select("id", "n", digest(F.col("n")).alias("d"), sha256(F.col("n")).alias("sha"))
    digests = stable(texts.select("id", "d", "sha"))
    least = max(digests.count() // hot_share, salts)
    hot = stable(digests.groupBy("d").count().where(F.col("count") > least).select("d", F.lit(True).alias("hot")))
    found = stable(classes(texts, hot, salts).select("d", "keep_id", "group_size"))
    shared = stable(found.groupBy("d").count().where("count > 1").select("d"))
    members = of_digest(digests, found.join(shared, "d", "left_anti"), hot).select("id", "sha", "keep_id", "group_size")
    if not shared.isEmpty():
        # different texts of one digest: a row finds its group by its text
        among = texts.join(shared, "d", "left_semi")
        own = among.groupBy("d", "n").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        members = members.unionByName(among.join(own, ["d", "n"]).select(members.columns))
    members = stable(members).withColumn("u", F.monotonically_increasing_id())
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    first = members.where(kept).groupBy("keep_id", "sha").agg(F.min("u").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    members = matched(members, small(stable(first)), ["keep_id", "sha"], "left")
    kept = kept & (F.col("u") == F.coalesce("first", "u"))
    return members.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their columns as they are.

    Rows are matched by doc_id (null to null) and text digest; of repeated rows one stays. Null texts
    count as empty; an empty table stays empty.
    """
    stay = exact_dedup(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias("sha"))
    rows = in_rows(docs, doc_id=F.col("doc_id"), sha=sha256(normalised(F.col("text"))))
    return without_repeats(matched(rows, stay, ["doc_id", "sha"], "left_semi"), "doc_id", "sha").select("row.*")
