"""Joining evidence into cases as it arrives: open cases are state, carried from one slice of time to the next.

In order of (us, evidence_id) each item looks for open cases that show one of its join tokens: seen within
``WINDOW``, or within ``STICKY`` where the case has the item's customer and has reached stage S2. A case that
only payees link to it stays apart unless two of them do, or one is suspicious and both sides are. Without
a case, an item above the base rate opens one; with several, they merge into the one of the highest
probability (ties: the oldest, then the least id). A case without a customer takes the first one it sees.

A slice is worked off in parallel by what can meet in it: items and carried cases of one customer, and those that show
what another one still looks for, form a component, whose rows go through one fold in order, a batch at a time; the fold
holds open cases only, and tells a case once, when it ends or with the slice. The cases that are still open go on
to the next slice, so cuts do not change what is joined, and shorter slices make smaller components.

Items: evidence_id (string), us, customer, stage, p, weight, family, entities (array of tokens), tokens
(array of join tokens), bridges and odd (arrays of those tokens that are payees, and suspicious).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DAY
from ..sources.stable import stable
from .cases import BRIDGES, STICKY, STICKY_FROM, WINDOW
from .components import components
from .fusion import STAGES
from .state import folded_rows

CLOSE, CASE, ITEM = 0, 1, 2
OUT = (
    "what string, seq long, case_id string, evidence_id string, into string, anchor string, customer string, opened long, last long, later boolean, "
    "entities array<string>, absorbed array<string>, families array<string>, sums array<double>, highest array<double>"
)
STATE = ("anchor", "customer", "opened", "last", "later", "entities", "absorbed", "families", "sums", "highest")


@dataclass
class Case:
    case_id: str
    anchor: str | None
    customer: str | None
    opened: int
    last: int
    later: bool = False
    entities: set = field(default_factory=set)
    absorbed: set = field(default_factory=set)
    worth: dict = field(default_factory=dict)

    def log_odds(self) -> float:
        """Without the base rate and without patterns: what orders cases by probability."""
        return sum((total + most) / 2 for total, most in self.worth.values())

    def add(self, family: str, total: float, most: float) -> None:
        a, b = self.worth.get(family, (0.0, float("-inf")))
        self.worth[family] = (a + total, max(b, most))


class Joining:
    """The open cases of one component, and what each next row makes of them."""

    def __init__(self, base_rate: float):
        self.base_rate, self.base, self.seq = base_rate, log(base_rate / (1 - base_rate)), 0
        self.open: dict[str, Case] = {}
        self.by_token: dict[str, set[str]] = {}
        self.gone: dict[str, str] = {}
        self.over: list[Case] = []

    def put(self, case: Case) -> None:
        self.open[case.case_id] = case
        for t in case.entities:
            self.by_token.setdefault(t, set()).add(case.case_id)

    def take(self, case_id: str) -> Case:
        case = self.open.pop(case_id)
        for t in case.entities:
            self.by_token[t].discard(case_id)
            if not self.by_token[t]:
                del self.by_token[t]
        return case

    def p(self, case: Case) -> float:
        return 1 / (1 + exp(-(self.base + case.log_odds())))

    def candidates(self, r) -> list[Case]:
        tokens, bridges, odd = set(r.tokens), set(r.bridges), set(r.odd)
        found = []
        for case_id in sorted({c for t in tokens for c in self.by_token.get(t, ())}):
            case = self.open[case_id]
            sticky = case.customer is not None and case.customer == r.customer and case.later
            if r.us - case.last > (STICKY if sticky else WINDOW):
                if r.us - case.last > STICKY:
                    self.over.append(self.take(case_id))
                continue
            shared = tokens & case.entities
            over = shared & bridges
            sure = bool(over & odd) and r.p > self.base_rate and self.p(case) > self.base_rate
            if sticky or shared - bridges or len(over) >= BRIDGES or sure:
                found.append(case)
        return found

    def merge(self, cases: list[Case], rows: list) -> Case:
        kept = min(cases, key=lambda c: (-c.log_odds(), c.opened, c.case_id))
        for other in cases:
            if other is kept:
                continue
            self.take(other.case_id)
            for t in other.entities - kept.entities:
                self.by_token.setdefault(t, set()).add(kept.case_id)
            kept.entities |= other.entities
            kept.absorbed |= other.absorbed | {other.case_id}
            kept.opened, kept.last, kept.later = min(kept.opened, other.opened), max(kept.last, other.last), kept.later or other.later
            kept.customer = kept.customer if kept.customer is not None else other.customer
            for name, (total, most) in other.worth.items():
                kept.add(name, total, most)
            self.gone |= dict.fromkeys(other.absorbed | {other.case_id}, kept.case_id)
            rows.append(("merge", self.seq, other.case_id, None, kept.case_id))
        return kept

    def attach(self, r, rows: list) -> Case | None:
        found = self.candidates(r)
        if not found and r.p <= self.base_rate:
            return None
        customer = None if pd.isna(r.customer) else r.customer
        if found:
            case = found[0] if len(found) == 1 else self.merge(found, rows)
            if customer is not None and not (case.anchor or "").startswith("cust:"):
                case.anchor = case.customer = customer
        else:
            case = Case(f"case:{r.evidence_id}", customer if customer is not None else min(r.entities, default=None), customer, int(r.us), int(r.us))
            self.open[case.case_id] = case
        for t in set(r.entities) - case.entities:
            case.entities.add(t)
            self.by_token.setdefault(t, set()).add(case.case_id)
        case.last = max(case.last, int(r.us))
        case.later = case.later or (r.weight > 0 and STAGES.index(r.stage) >= STAGES.index(STICKY_FROM))
        case.add(r.family, r.weight, r.weight)
        rows.append(("item", self.seq, case.case_id, r.evidence_id, None))
        return case

    def close(self, case_id: str) -> Case | None:
        case_id = self.gone.get(case_id, case_id)
        if case_id not in self.open:
            return None
        case = self.take(case_id)
        case.last = -1 - case.last  # below zero: no item joins it any more, and no slice carries it
        return case

    def told(self, case: Case) -> tuple:
        names = sorted(case.worth)
        state = (case.anchor, case.customer, case.opened, case.last, case.later, sorted(case.entities), sorted(case.absorbed), names, [case.worth[n][0] for n in names], [case.worth[n][1] for n in names])
        return ("case", self.seq, case.case_id, None, None, *state)

    def step(self, r) -> list[tuple]:
        rows: list = []
        self.seq += 1
        if r.what == CASE:
            case = Case(r.evidence_id, r.anchor, None if pd.isna(r.customer) else r.customer, int(r.opened), int(r.last), bool(r.later), set(r.entities), set(r.absorbed))
            self.gone |= dict.fromkeys(case.absorbed, case.case_id)
            for name, total, most in zip(r.families, r.sums, r.highest, strict=True):
                case.add(name, total, most)
            self.put(case)
        elif r.what == CLOSE:
            case = self.close(f"case:{r.evidence_id}")
            self.over.extend([case] if case is not None else [])
        else:
            self.attach(r, rows)
        out = [(*x, *[None] * 10) for x in rows] + [self.told(case) for case in self.over]
        self.over.clear()
        return out

    def end(self) -> list[tuple]:
        return [self.told(case) for case in self.open.values()]


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (with node) with the component that they belong to; rows without a token are alone."""
    return rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("node", "root")


def _node(customer: Column, alone: Column) -> Column:
    """What a customer's rows have in common, by a hash: two of one number only make their components fold together."""
    return F.when(customer.isNotNull(), F.xxhash64(F.lit("customer"), customer)).otherwise(F.xxhash64(alone))


def _edges(rows: DataFrame, base_rate: float) -> DataFrame:
    """(a, b): tokens and nodes of the rows that may meet over them.

    A row meets who shows what it looks for, before it. A payee alone is looked for in vain by an item that has no second
    one, unless it is suspicious and the item above the base rate; a token that nobody looks for later links nothing.
    """
    empty = F.array().cast("array<string>")
    payees = F.when(F.size("bridges") >= BRIDGES, F.col("bridges")).when(F.col("p") > base_rate, F.array_intersect("bridges", "odd")).otherwise(empty)
    looked = F.when(F.col("what") == ITEM, F.array_union(F.array_except("tokens", "bridges"), payees)).when(F.col("what") == CLOSE, F.col("all")).otherwise(empty)
    shown = rows.select("node", "us", F.explode(F.transform("all", lambda t: F.xxhash64(t))).alias("a"))
    asked = rows.select("node", "us", F.explode(F.transform(looked, lambda t: F.xxhash64(t))).alias("a"))
    shown = shown.groupBy("a", "node").agg(F.min("us").alias("us"))
    until = asked.groupBy("a").agg(F.max("us").alias("until"))
    meeting = shown.join(until, "a").where(F.col("us") <= F.col("until"))
    return meeting.select("a", F.col("node").alias("b"))


def _slice(items: DataFrame, carried: DataFrame | None, base_rate: float) -> DataFrame:
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = F.array_union("tokens", "entities")
    empty = F.array().cast("array<string>")
    rows = items.select(
        F.col("what"), "us", "evidence_id", "customer", "stage", "p", "weight", "family", "entities", "tokens", "bridges", "odd", both.alias("all"),
        none("anchor", "string"), none("opened", "long"), none("last", "long"), none("later", "boolean"), none("absorbed", "array<string>"), none("families", "array<string>"), none("sums", "array<double>"), none("highest", "array<double>"),
    )
    if carried is not None:
        own = carried.select(
            F.lit(CASE).alias("what"), F.lit(-1).cast("long").alias("us"), F.col("case_id").alias("evidence_id"), "customer", none("stage", "string"), none("p", "double"), none("weight", "double"), none("family", "string"),
            "entities", empty.alias("tokens"), empty.alias("bridges"), empty.alias("odd"), F.col("entities").alias("all"), "anchor", "opened", "last", "later", "absorbed", "families", "sums", "highest",
        )
        rows = rows.unionByName(own)
    rows = stable(rows.withColumn("node", _node(F.col("customer"), F.col("evidence_id"))))
    rows = _labelled(rows.drop("all"), components(_edges(rows, base_rate)))
    return stable(folded_rows(rows, "label", ["us", "evidence_id", "what"], lambda: Joining(base_rate), OUT))


def join_cases(items: DataFrame, slice_us: int = 10 * DAY, base_rate: float = 0.01, closings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(evidence_id, case_id) of every item that is in a case, and (case_id, anchor, customer, opened, last) of all cases.

    ``closings`` (evidence_id, us): when the case that this item opened is closed; later items do not join
    it. Slices are worked off one after the other; an item of no case is left out; an empty table gives
    empty results.
    """
    rows = items.withColumn("what", F.lit(ITEM))
    if closings is not None:
        ends = closings.select("evidence_id", F.col("us").alias("at")).join(items, "evidence_id").withColumns({"us": F.col("at"), "what": F.lit(CLOSE)}).drop("at")
        rows = rows.unionByName(ends)
    rows = stable(rows)
    span = rows.agg(F.min("us").alias("first"), F.max("us").alias("last")).first()
    # an empty table is one slice of nothing
    first, last = (span["first"] // slice_us, span["last"] // slice_us) if span["first"] is not None else (0, 0)
    found, carried, cases = [], None, None
    for i in range(first, last + 1):
        out = _slice(rows.where((F.col("us") >= i * slice_us) & (F.col("us") < (i + 1) * slice_us)), carried, base_rate)
        found.append(out.where("what <> 'case'").select("what", "seq", "case_id", "evidence_id", "into").withColumn("slice", F.lit(i)))
        dropped = out.where("what = 'merge'").select("case_id")
        states = out.where("what = 'case'").groupBy("case_id").agg(F.max_by(F.struct(*STATE), "seq").alias("x")).select("case_id", "x.*").join(dropped, "case_id", "left_anti")
        states = stable(states)
        open_still = (F.col("last") >= 0) & (F.col("last") >= (i + 1) * slice_us - STICKY)
        ended = states.where(~open_still).select("case_id", "anchor", "customer", "opened", "last")
        cases = ended if cases is None else cases.unionByName(ended)
        carried = states.where(open_still)
    cases = cases.unionByName(carried.select("case_id", "anchor", "customer", "opened", "last"))
    cases = cases.withColumn("last", F.when(F.col("last") < 0, -1 - F.col("last")).otherwise(F.col("last")))
    every = stable(_union(found))
    merges = resolved(every.where("what = 'merge'").select("case_id", "into"))
    own = every.where("what = 'item'").select("evidence_id", "case_id").join(merges, "case_id", "left")
    return own.select("evidence_id", F.coalesce("into", "case_id").alias("case_id")), cases


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def resolved(merges: DataFrame) -> DataFrame:
    """(case_id, into): where each merged case ended up, by jumping over cases that were merged later."""
    merges = stable(merges)
    while True:
        further = merges.select(F.col("case_id").alias("into"), F.col("into").alias("top"))
        jumped = stable(merges.join(further, "into", "left").select("case_id", F.coalesce("top", "into").alias("into"), F.col("top").isNotNull().alias("moved")))
        merges = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return merges
