"""Evidence of one fact told by two families counts less: the weaker of each pair is discounted.

Within a case the positive items of a group's reasons are taken from the strongest on (ties by us, then
evidence_id). An item is paired with the first kept one of another family that shares a customer with it and
lies within the window, and is discounted by it; without one it is kept. The first group that pairs an item
counts. A case's items go through one fold in that order, a batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MINUTE
from .state import folded_rows


@dataclass(frozen=True)
class Group:
    name: str
    reasons: tuple[str, ...]
    factor: float = 0.5


class Kept:
    """The kept items of one case by group, and what they discount."""

    def __init__(self, groups: tuple[Group, ...], window: int):
        self.groups, self.window = groups, window
        self.kept: dict[str, list[tuple]] = {g.name: [] for g in groups}

    def step(self, r) -> list[tuple]:
        customers, reasons = set(r.customers), set(r.reasons)
        for g in self.groups:
            if reasons.isdisjoint(g.reasons):
                continue
            partner = next((k for k in self.kept[g.name] if k[1] != r.family and abs(k[2] - r.us) <= self.window and not customers.isdisjoint(k[3])), None)
            if partner is not None:
                return [(r.case_id, r.evidence_id, g.name, partner[0], g.factor)]
            self.kept[g.name].append((r.evidence_id, r.family, r.us, customers))
        return []

    def end(self) -> list[tuple]:
        return []


def discounts(contributed: DataFrame, groups: tuple[Group, ...], window: int = 60 * MINUTE) -> DataFrame:
    """(case_id, evidence_id, group, kept, factor) of every discounted item of ``contributed`` (case_id, evidence_id, us, family,
    contribution, reasons, customers: array). Items without a customer pair with nothing; off where no group is given."""

    rows = contributed.where("contribution > 0").select("case_id", "evidence_id", "us", "family", "reasons", F.coalesce("customers", F.array().cast("array<string>")).alias("customers"), (-F.col("contribution")).alias("order"))
    kind = contributed.schema["evidence_id"].dataType.simpleString()
    return folded_rows(rows, "case_id", ["order", "us", "evidence_id"], lambda: Kept(groups, window), f"case_id string, evidence_id {kind}, group string, kept {kind}, factor double")


def discounted(contributed: DataFrame, found: DataFrame) -> DataFrame:
    """``contributed`` with the discounted contributions."""
    rows = contributed.join(found.select("case_id", "evidence_id", "factor"), ["case_id", "evidence_id"], "left")
    return rows.withColumn("contribution", F.col("contribution") * F.coalesce("factor", F.lit(1.0))).drop("factor")
