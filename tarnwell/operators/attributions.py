"""What each feature adds to the margin of boosted trees: exact Shapley values along the trees' own paths.

A feature that is not known sends a row both ways, in proportion to the training weight on each side. So a leaf is
a game of the features on its path: with feature j known it counts 1 or 0 (does the row take the path's turns at
j), unknown the product of j's shares. Its Shapley values hang only on which of these features take the path, so
each leaf has a table of 2^d rows made once, and a row's values are sums of table rows, one a leaf.

Values of a row add up to its margin less the margin that the trees expect of no row in particular.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, prod

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stable import shared_folder
from .models import vectors

#: Features of one path at most: a leaf's table has two rows to the power of them.
MOST_ON_A_PATH = 12
#: Fixed values of the domain: what a payment's feature is called as a reason.
REASONS = {
    "log_amount": "AMOUNT_HIGH", "amount_to_median_30d": "AMOUNT_HIGH_VS_MEDIAN", "txn_count_1h": "TXN_VELOCITY_1H", "txn_sum_24h_paise": "TXN_SUM_24H",
    "payee_is_new": "NEW_PAYEE", "minutes_since_payee_added": "PAYEE_RECENTLY_ADDED", "payee_fan_in_24h": "PAYEE_FAN_IN", "payee_sum_24h_paise": "PAYEE_SUM_24H",
    "near_limit_count_24h": "NEAR_LIMIT_AMOUNTS", "hour_deviation": "ODD_HOUR", "minutes_since_new_device": "RECENT_NEW_DEVICE",
}


@dataclass(frozen=True)
class Leaf:
    """The turns at each feature of its path (above ``low``, not above ``high``; None: no such turn), and its table."""

    turns: tuple[tuple[int, float | None, float | None], ...]
    table: np.ndarray
    expected: float


def table(shares: list[float], value: float) -> np.ndarray:
    """Row ``b``: Shapley values of the features, where bit j of b says that feature j takes the path."""
    d = len(shares)
    out = np.zeros((1 << d, d))
    for b in range(1 << d):
        takes = [(b >> j) & 1 for j in range(d)]
        for j in range(d):
            sizes = np.ones(1)  # by number of known others: the sum of products over such sets
            for i in range(d):
                if i != j:
                    sizes = np.convolve(sizes, [shares[i], takes[i]])
            known = sum(c * factorial(k) * factorial(d - 1 - k) for k, c in enumerate(sizes)) / factorial(d)
            out[b, j] = value * (takes[j] - shares[j]) * known
    return out


def leaves(model: GBTClassificationModel) -> list[Leaf]:
    """All leaves of the trees, read from the model as Spark saves it: as many rows as the trees have nodes."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/model"
    model.save(path)
    trees: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    found = []
    for tree, nodes in trees.items():
        waiting = [(0, {}, {})]
        while waiting:
            at, turns, shares = waiting.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                value = node["prediction"] * model.treeWeights[tree]
                order = sorted(turns)
                if len(order) > MOST_ON_A_PATH:
                    raise ValueError(f"a path of {len(order)} features: at most {MOST_ON_A_PATH}")
                found.append(Leaf(tuple((f, *turns[f]) for f in order), table([shares[f] for f in order], value), value * prod(shares.values())))
                continue
            f, (threshold, *more), kinds = node["split"]
            if kinds != -1 or more:
                raise ValueError("splits by categories are not read")
            low, high = turns.get(f, (None, None))
            for side, turn in (("leftChild", (low, threshold if high is None else min(high, threshold))), ("rightChild", (threshold if low is None else max(low, threshold), high))):
                share = nodes[node[side]]["impurityStats"][0] / node["impurityStats"][0]
                waiting.append((node[side], turns | {f: turn}, shares | {f: shares.get(f, 1.0) * share}))
    return found


def values(x: np.ndarray, found: list[Leaf]) -> np.ndarray:
    """Shapley values of the rows of ``x``."""
    out = np.zeros(x.shape)
    for leaf in found:
        if not leaf.turns:
            continue
        pattern = np.zeros(len(x), dtype=np.int64)
        for j, (f, low, high) in enumerate(leaf.turns):
            takes = np.ones(len(x), dtype=bool)
            if high is not None:
                takes &= x[:, f] <= high
            if low is not None:
                takes &= ~(x[:, f] <= low)
            pattern |= takes.astype(np.int64) << j
        out[:, [f for f, _, _ in leaf.turns]] += leaf.table[pattern]
    return out


def attributed(model: GBTClassificationModel, rows: DataFrame, features: tuple[str, ...], key: str) -> DataFrame:
    """(key, margin, expected, features: array of (feature, value, added) in the given order) of each of ``rows``.

    A null feature counts as 0 and a NaN is an error, as for the model."""
    found, n = leaves(model), len(features)
    expected = sum(leaf.expected for leaf in found)
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.stack(part["x"].to_numpy()).astype(float)
                yield pd.DataFrame({key: part[key], "margin": part["margin"], "x": list(x), "added": list(values(x, found))})

    margin = vector_to_array("rawPrediction")[1]
    known = model.transform(vectors(rows.select(key, *features), features)).select(key, margin.alias("margin"), vector_to_array("vector").alias("x"))
    out = known.mapInPandas(run, f"{key} {kind}, margin double, x array<double>, added array<double>")
    each = [F.struct(F.lit(f).alias("feature"), F.get("x", i).alias("value"), F.get("added", i).alias("added")) for i, f in zip(range(n), features, strict=True)]
    return out.select(key, "margin", F.lit(expected).alias("expected"), F.array(*each).alias("features"))


def _ranked(column: str, rank) -> Column:
    """By ``rank`` of what was added, greatest first; equal ones in the order of the features."""
    keyed = F.transform(column, lambda x, i: F.struct((-rank(x["added"])).alias("rank"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def strongest(column: str = "features", n: int = 5) -> Column:
    """The ``n`` features that added most, up or down."""
    return F.slice(_ranked(column, F.abs), 1, n)


def reasons(column: str = "features", n: int = 3) -> Column:
    """Codes of the ``n`` features that raised the margin most; a feature without a code is none."""
    codes = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    up = F.filter(_ranked(column, lambda c: c), lambda x: (x["added"] > 0) & F.element_at(codes, x["feature"]).isNotNull())
    return F.slice(F.transform(up, lambda x: F.element_at(codes, x["feature"])), 1, n)
