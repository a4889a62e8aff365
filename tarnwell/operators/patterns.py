"""Patterns of a case's evidence, compiled from a file to windows.

A pattern is a sequence of stages or an entity seen before. Each step of a sequence is a hit where its stage
occurs after a hit of the step before; a hit carries the latest start of a chain that ends in it, as that start is
the one that any limit on the whole chain leaves last. So one maximum per step stands for all chains, and steps of
all patterns share their windows: one sort of a case's items whatever the number of patterns.

Only items of positive weight count, in order of (us, evidence_id); of one instant, the lower id comes first. A
pattern is judged after each item: a stage that must be absent takes it away again, and so does a pattern listed
before it that it yields to.

The file is a JSON list, in order of judgement. Fixed values of the domain are in ``patterns.json``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MINUTE

#: Fixed values of the domain: stages in order.
STAGES = ("S0_RECON", "S1_INITIAL_ACCESS", "S2_CONTROL_TAKEOVER", "S3_IDENTITY_MANIPULATION", "S4_ESCALATION", "S5_POSITIONING", "S6_MONETIZATION")


@dataclass(frozen=True)
class Pattern:
    """``within_min`` bounds each step after the one before, ``total_within_min`` the last after the first."""

    id: str
    bonus: float
    sequence: tuple[str, ...] = ()
    within_min: float | None = None
    total_within_min: float | None = None
    first_reason_any: tuple[str, ...] = ()
    absent_stages: tuple[str, ...] = ()
    unless_patterns: tuple[str, ...] = ()
    when_detector: str | None = None
    shares_entity_kind_with_earlier_evidence: str | None = None
    label: str = ""


def extended(patterns: tuple[Pattern, ...], items: list[dict]) -> tuple[Pattern, ...]:
    """``patterns`` and those of a file's objects after them; one that cannot be judged as written is an error."""
    found = list(patterns)
    for item in items:
        name = item.get("id")
        try:
            p = Pattern(**{k: tuple(v) if isinstance(v, list) else v for k, v in item.items() if v is not None})
        except TypeError as e:
            raise ValueError(f"pattern {name}: {e}") from None
        known = {q.id for q in found}
        if bool(p.sequence) == bool(p.shares_entity_kind_with_earlier_evidence):
            raise ValueError(f"pattern {name}: either a sequence or an entity kind")
        if p.sequence and (len(p.sequence) < 2 or not set(p.sequence + p.absent_stages) <= set(STAGES)):
            raise ValueError(f"pattern {name}: a sequence has two or more known stages")
        if name in known or not set(p.unless_patterns) <= known:
            raise ValueError(f"pattern {name}: ids are unique and name patterns listed before")
        found.append(p)
    return tuple(found)


def read(path: str | Path) -> tuple[Pattern, ...]:
    return extended((), json.loads(Path(path).read_text(encoding="utf-8")))


PATTERNS = read(Path(__file__).with_name("patterns.json"))


def _before(value: str, minutes: float | None) -> Column:
    """The greatest ``value`` of items before this one in order, at most ``minutes`` ago.

    A later hit of a step never carries an earlier start, so the last hit before carries the greatest one: frames only
    grow, and no item meets the items of a busy case's last day.
    """
    earlier = Window.partitionBy("case_id").orderBy("us", "evidence_id").rowsBetween(Window.unboundedPreceding, -1)
    greatest = F.max(value).over(earlier)
    if minutes is None:
        return greatest
    last = F.max(F.when(F.col(value).isNotNull(), F.col("us"))).over(earlier)
    return F.when(F.col("us") - last <= int(minutes * MINUTE), greatest)


def _shown(rows: DataFrame, kinds: set[str]) -> DataFrame:
    """(case_id, evidence_id, shown): kinds of entity of an item that an earlier live item of its case has too."""
    kind = F.substring_index("token", ":", 1)
    live = rows.where("live").select("case_id", "evidence_id", "us", F.explode(F.array_distinct("entities")).alias("token")).where(kind.isin(*sorted(kinds)))
    again = F.row_number().over(Window.partitionBy("case_id", "token").orderBy("us", "evidence_id")) > 1
    return live.withColumn("again", again).where("again").groupBy("case_id", "evidence_id").agg(F.collect_set(kind).alias("shown"))


def with_hits(rows: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """``rows`` (case_id, evidence_id, us, stage, detector, reasons, live and, for entity patterns, entities) with what holds
    after each item: hits, an array of (pattern, bonus, evidence_id: which completed it), and the sum of the bonuses.

    Without a column entities no entity pattern holds. A null stage, detector, reasons or entities matches nothing."""
    columns = rows.columns
    kinds = {p.shares_entity_kind_with_earlier_evidence for p in patterns} - {None}
    if kinds and "entities" in columns:
        rows = rows.join(_shown(rows, kinds), ["case_id", "evidence_id"], "left")
    else:
        rows = rows.withColumn("shown", F.array().cast("array<string>"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    strings = lambda values: F.array(*map(F.lit, values))
    at, us = lambda p, step: yes(F.col("live") & (F.col("stage") == p.sequence[step])), F.col("us")
    sequences = [(i, p) for i, p in enumerate(patterns) if p.sequence]
    first = lambda p: at(p, 0) & yes(F.arrays_overlap("reasons", strings(p.first_reason_any))) if p.first_reason_any else at(p, 0)
    rows = rows.withColumns({f"from_{i}": F.when(first(p), us) for i, p in sequences})
    for step in range(1, max((len(p.sequence) for _, p in sequences), default=0)):
        going = [(i, p) for i, p in sequences if step < len(p.sequence)]
        rows = rows.withColumns({f"prev_{i}": _before(f"from_{i}", p.within_min) for i, p in going})
        in_time = lambda i, p: F.lit(True) if p.total_within_min is None else us - F.col(f"prev_{i}") <= int(p.total_within_min * MINUTE)
        rows = rows.withColumns({f"from_{i}": F.when(at(p, step) & in_time(i, p), F.col(f"prev_{i}")) for i, p in going})

    def completes(i: int, p: Pattern) -> Column:
        if p.sequence:
            return F.col(f"from_{i}").isNotNull()
        of = F.lit(True) if p.when_detector is None else F.col("detector") == p.when_detector
        return yes(F.col("live") & of & F.array_contains("shown", p.shares_entity_kind_with_earlier_evidence))

    case = Window.partitionBy("case_id").orderBy("us", "evidence_id").rowsBetween(Window.unboundedPreceding, 0)
    held: dict[str, Column] = {}
    facts = {f"by_{i}": F.first(F.when(completes(i, p), F.col("evidence_id")), ignorenulls=True).over(case) for i, p in enumerate(patterns)}
    facts |= {f"spoilt_{i}": F.max(yes(F.col("live") & F.col("stage").isin(*p.absent_stages))).over(case) for i, p in enumerate(patterns) if p.absent_stages}
    rows = rows.withColumns(facts)
    for i, p in enumerate(patterns):
        held[p.id] = F.col(f"by_{i}").isNotNull()
        for other in [held[u] for u in p.unless_patterns] + ([F.col(f"spoilt_{i}")] if p.absent_stages else []):
            held[p.id] = held[p.id] & ~other
    hit = lambda i, p: F.struct(F.lit(p.id).alias("pattern"), F.lit(float(p.bonus)).alias("bonus"), F.col(f"by_{i}").alias("evidence_id"))
    kind = rows.schema["evidence_id"].dataType.simpleString()
    hits = F.array_compact(F.array(*[F.when(held[p.id], hit(i, p)) for i, p in enumerate(patterns)])) if patterns else F.array()
    bonus = sum((F.when(held[p.id], float(p.bonus)).otherwise(0.0) for p in patterns), F.lit(0.0))
    return rows.select(*columns, hits.cast(f"array<struct<pattern:string,bonus:double,evidence_id:{kind}>>").alias("hits"), bonus.alias("bonus"))
