"""Joining by what lies near: looked up once for items of the same tokens, and dealt to enough tasks."""

import random

from tarnwell.operators import cases

from .test_cases import ITEM, S2, S5, frame


def nearest(items, near, excluded, good):
    """The definition, item by item."""
    out = set()
    for i, _, _, _, _, own, entities in items:
        shown = {t: t.startswith("acct:") and t not in own for t in entities if t.split(":")[0] in cases.KINDS and t not in excluded}
        shown = {t: bridge for t, bridge in shown.items() if not (bridge and t in good)}
        found = {t: [bridge, 0, True] for t, bridge in shown.items()}
        for start, token, hops, direct in near:
            if start in shown and not (token.startswith("acct:") and token not in own and token in good):
                at = found.setdefault(token, [True, hops, False])
                at[0], at[1] = at[0] and (shown[start] or not direct), min(at[1], hops)
        out |= {(i, t, b, s) for t, (b, h, s) in sorted(found.items(), key=lambda x: (x[1][1], x[0]))[: cases.MOST_TOKENS]}
    return out


def test_tokens_near_are_those_of_the_definition_and_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(cases, "ROWS", 10)
    monkeypatch.setattr(cases, "MOST_TOKENS", 6)
    rnd, items = random.Random(5), []
    for i in range(120):
        c = rnd.randrange(3)
        items.append((i, i, f"cust:{c}", rnd.choice([S2, S5]), 0.2, [f"acct:{c}"], rnd.sample([f"cust:{c}", f"acct:{c}", "dev:1", "acct:8", "acct:9", "cid:1", "dev:9"], rnd.randint(1, 4))))
    starts = [f"{t}:{n}" for t in ("cust", "acct", "dev") for n in range(10)]
    near = sorted({(s, t): (s, t, rnd.randint(1, 2), rnd.random() < 0.5) for s in starts for t in rnd.sample(starts, 5) if s != t}.values())
    rows = cases.join_tokens(spark.createDataFrame(items, ITEM), frame(spark, ["dev:9"]), frame(spark, ["acct:9", "acct:4"]), spark.createDataFrame(near, "start string, token string, hops int, direct boolean"))
    assert rows.rdd.getNumPartitions() >= 10
    got = [(r["evidence_id"], r["token"], r["bridge"], r["shown"]) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == nearest(items, near, {"dev:9"}, {"acct:9", "acct:4"})


def test_an_item_keeps_all_tokens_near_it(spark):
    near = [("acct:1", f"dev:{n}", 1 + n % 2, True) for n in range(350)]
    items = [(1, 0, "cust:1", S5, 0.2, ["acct:1"], ["acct:1"])] + [(2 + n, 1 + n, f"cust:{2 + n}", S2, 0.2, [], [f"dev:{n}"]) for n in (0, 349)]
    rows = cases.join_tokens(spark.createDataFrame(items, ITEM), frame(spark, []), frame(spark, []), spark.createDataFrame(near, "start string, token string, hops int, direct boolean"))
    got = {(r["evidence_id"], r["token"], r["bridge"], r["shown"]) for r in rows.collect()}
    assert got == nearest(items, near, set(), set()) and len(got) == 353
