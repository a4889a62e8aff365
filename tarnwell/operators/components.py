"""Connected components of an edge table: forests within ranges of nodes, level by level, then rounds of joins that Spark may split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stable import stable


#: Edges that a task holds as one forest, and that one task may finish alone; what a level must leave at most to be followed by another.
MOST, SHRINK = 500_000, 0.75


def _forest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges as forests of at most about ``MOST`` nodes: every node that reaches a lesser one, with the least that it reaches."""
    over: dict = {}

    def root(x):
        while (y := over.setdefault(x, x)) != x:
            over[x] = over[y]
            x = over[x]
        return x

    def found() -> pd.DataFrame:
        pairs = [(x, r) for x in list(over) if (r := root(x)) != x]
        over.clear()
        return pd.DataFrame(pairs, columns=["a", "b"])

    for part in parts:
        for a, b in zip(part["a"].tolist(), part["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                over[max(a, b)] = min(a, b)
        if len(over) > MOST:
            yield found()
    yield found()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the least node that it reaches.

    A level deals the edges by ranges of their lesser node to tasks of about ``MOST`` edges. Each makes forests of its own;
    what goes on to the next level are edges between the roots of forests that share a node. So where nodes near each other in order
    hang together (items in order of time), one or two levels leave few edges, which one task finishes. Where a level hardly
    shrinks the edges, rounds of joins (:func:`_rounds`) finish them.
    """
    kind = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in ("a", "b"))
    edges = stable(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    levels, before = [], None
    while (n := edges.count()) > MOST and (before is None or n <= SHRINK * before):
        part = edges.repartitionByRange(-(-n // max(MOST, 1)), "a").sortWithinPartitions("a").mapInPandas(_forest, kind)
        hung = stable(part.toDF("node", "root").distinct())
        roots = hung.select("root").distinct()
        hung = hung.unionByName(roots.select(F.col("root").alias("node"), "root"))
        least = stable(hung.groupBy("node").agg(F.min("root").alias("least")))
        levels.append(least)
        edges = stable(hung.join(least, "node").where("root != least").select(F.col("least").alias("a"), F.col("root").alias("b")).distinct())
        before = n
    if n <= MOST:
        star = stable(edges.coalesce(1).mapInPandas(_forest, kind))
        found = star.toDF("node", "root").unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    else:
        found = _rounds(edges, kind)
    for least in reversed(levels):
        found = least.join(found.select(F.col("node").alias("least"), "root"), "least", "left").select("node", F.coalesce("root", "least").alias("root"))
    return stable(found) if levels else found


def _rounds(edges: DataFrame, kind: str) -> DataFrame:
    """Components by rounds: in each, every root that has a lesser root next to it hangs under the least of those, then all nodes
    move to their root's root until they stand still; edges inside one tree are dropped."""
    less = lambda df: df.select("a", "b").where("a != b").mapInPandas(_forest, kind).distinct()
    edges = stable(less(edges))
    roots = stable(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        under = stable(both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("over")).where("over < child"))
        while True:
            upper = under.select(F.col("child").alias("over"), F.col("over").alias("top"))
            jumped = stable(under.join(upper, "over", "left").select("child", F.coalesce("top", "over").alias("over"), F.col("top").isNotNull().alias("moved")))
            under = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        roots = stable(roots.join(under, F.col("root") == F.col("child"), "left").select("node", F.coalesce("over", "root").alias("root")))
        for side in ("a", "b"):
            moved = under.select(F.col("child").alias(side), "over")
            edges = edges.join(moved, side, "left").withColumn(side, F.coalesce("over", side)).drop("over")
        edges = stable(less(edges))
    return roots
