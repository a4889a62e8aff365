"""Connected components of an edge list: local union-find, then contraction until no edge is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as a forest: every node that reaches a lesser one, with the least that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = np.array([root(i) for i in range(len(nodes))], np.int64)
    own = roots != np.arange(len(nodes))
    return nodes[own], nodes[roots[own]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not its component's least node; ``edges``: a, b (longs).

    In each round a node hangs under its least neighbour and edges move to the parents, so the graph
    shrinks until none is left; the rounds' parents are then followed one after the other. A node of
    many edges is met by partial minima and by joins that Spark may split.
    """
    edges = stable(edges.select("a", "b").mapInArrow(_forest, "a long, b long").distinct())
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stable(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a"))
        rounds.append(parents)
        for side in ("a", "b"):
            up = parents.select(F.col("a").alias(side), F.col("p").alias(f"p{side}"))
            edges = edges.join(up, side, "left").withColumn(side, F.coalesce(f"p{side}", side)).drop(f"p{side}")
        edges = stable(edges.where("a != b").mapInArrow(_forest, "a long, b long").distinct())
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for parents in reversed(rounds[:-1]):
        below = parents.select(F.col("a").alias("node"), F.col("p").alias("root"))
        upper = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        below = below.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        found = below.unionByName(found.join(below, "node", "left_anti"))
    return found
