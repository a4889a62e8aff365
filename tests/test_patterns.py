"""Patterns compiled from a file against their definition, told item by item."""

import json
import random
import re

import pytest

from tarnwell.functions.scalars import MINUTE
from tarnwell.operators import patterns

SCHEMA = "case_id string, evidence_id long, us long, stage string, detector string, reasons array<string>, entities array<string>, live boolean"


def chains(items, sequence, p):
    """Every chain of items, one for each step, that the pattern allows."""
    found = [[x] for x in items if x[3] == sequence[0] and (not p.first_reason_any or set(x[5] or []) & set(p.first_reason_any))]
    for stage in sequence[1:]:
        found = [c + [x] for c in found for x in items if (x[2], x[1]) > (c[-1][2], c[-1][1]) and x[3] == stage and (p.within_min is None or x[2] - c[-1][2] <= p.within_min * MINUTE)]
    return [c for c in found if p.total_within_min is None or c[-1][2] - c[0][2] <= p.total_within_min * MINUTE]


def brute(rows, given):
    """(case, item) -> the patterns that hold after it with the items that completed them."""
    out = {}
    for case in {r[0] for r in rows}:
        items = sorted((r for r in rows if r[0] == case), key=lambda r: (r[2], r[1]))
        for n, item in enumerate(items):
            live, held = [x for x in items[: n + 1] if x[7]], {}
            for p in given:
                if {x[3] for x in live} & set(p.absent_stages) or set(p.unless_patterns) & set(held):
                    continue
                if p.sequence:
                    ends = [(c[-1][2], c[-1][1]) for c in chains(live, p.sequence, p)]
                else:
                    kind = p.shares_entity_kind_with_earlier_evidence + ":"
                    mine = [{t for t in x[6] or [] if t.startswith(kind)} for x in live]
                    ends = [(x[2], x[1]) for i, x in enumerate(live) if p.when_detector in (None, x[4]) and any(mine[i] & m for m in mine[:i])]
                if ends:
                    held[p.id] = min(ends)[1]
            out[case, item[1]] = (list(held.items()), round(sum(p.bonus for p in given if p.id in held), 9))
    return out


def found(spark, rows, given):
    got = patterns.with_hits(spark.createDataFrame(rows, SCHEMA), given).collect()
    return {(r["case_id"], r["evidence_id"]): ([(h["pattern"], h["evidence_id"]) for h in r["hits"]], round(r["bonus"], 9)) for r in got}


def drawn(seed, n=300):
    draw = random.Random(seed)
    stages = ["S1_INITIAL_ACCESS", "S2_CONTROL_TAKEOVER", "S5_POSITIONING", "S6_MONETIZATION", None]
    return [
        (f"case:{draw.randrange(12)}", i, draw.choice((0, 5, 30, 31, 700, 1440, 1441, 2000)) * MINUTE + draw.choice((0, 0, 1)), draw.choice(stages), draw.choice(("cyber", "auth", None)),
         draw.choice((["PAYEE_NAME_MISMATCH"], ["R", None], None)), draw.choice(([], None, ["ip:1"], ["ip:2", "ip:2"], ["dev:1", "ip:1"])), draw.choice((True, True, True, False, None)))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_the_files_patterns_and_more(spark, tmp_path, seed):
    """Ties of time, repeated stages, open windows, nulls: what the windows find is what the chains say."""
    more = [
        {"id": "twice", "sequence": ["S2_CONTROL_TAKEOVER", "S2_CONTROL_TAKEOVER", "S6_MONETIZATION"], "bonus": 0.2},
        {"id": "at_once", "sequence": ["S1_INITIAL_ACCESS", "S6_MONETIZATION"], "within_min": 0, "bonus": 0.1},
        {"id": "long", "sequence": ["S1_INITIAL_ACCESS", "S5_POSITIONING", "S1_INITIAL_ACCESS", "S6_MONETIZATION"], "total_within_min": 1500, "bonus": 0.7, "unless_patterns": ["at_once"]},
        {"id": "device", "shares_entity_kind_with_earlier_evidence": "dev", "bonus": 0.4},
    ]
    path = tmp_path / "patterns.json"
    path.write_text(json.dumps(more))
    rows = drawn(seed)
    assert len(patterns.PATTERNS) == 4
    for given in (patterns.PATTERNS, patterns.read(path), ()):
        want = brute(rows, given)
        assert found(spark, rows, given) == want
        assert {p for hits, _ in want.values() for p, _ in hits} == {p.id for p in given}


def test_a_file_that_cannot_be_judged_is_an_error():
    chain = {"id": "a", "bonus": 1, "sequence": ["S1_INITIAL_ACCESS", "S2_CONTROL_TAKEOVER"]}
    for items in ([chain, chain], [chain | {"sequence": ["S1_INITIAL_ACCESS"]}], [chain | {"sequence": ["S1_INITIAL_ACCESS", "S9"]}], [chain | {"unless_patterns": ["b"]}], [{"id": "a", "bonus": 1}], [chain | {"wthin_min": 3}], [chain | {"absent_stages": ["S9"]}]):
        with pytest.raises(ValueError):
            patterns.extended((), items)


def test_no_items_no_hits(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert patterns.with_hits(empty).collect() == [] == patterns.with_hits(empty.drop("entities")).collect()


def test_frames_only_grow(spark):
    """A frame that slides reads a busy case's last day anew for each of its items."""
    rows = patterns.with_hits(spark.createDataFrame(drawn(3), SCHEMA))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+),", plan)
    assert frames and {f.rstrip("$()") for f in frames} == {"unboundedpreceding"}
