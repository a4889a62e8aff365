"""Joining with state against plain Python, one item after the other; the graph as of each event."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.scalars import DAY, HOUR, MINUTE
from tarnwell.operators import asof, components, joiner
from tarnwell.operators.fusion import STAGES
from tarnwell.plans import case_queries
from tarnwell.sources.bridge import events, ordered

S1, S2 = STAGES[1], STAGES[2]
SCHEMA = "evidence_id string, us long, customer string, stage string, p double, weight double, family string, entities array<string>, tokens array<string>, bridges array<string>, odd array<string>"
BASE = 0.01


def brute(items, closings=()):
    """evidence_id -> case_id, case_id -> (anchor, customer, opened, last), by the definition."""
    cases, of, ends = {}, {}, {}
    steps = [(i[1], i[0], 2, i) for i in items] + [(us, e, 0, None) for e, us in closings]
    alias = {}
    for us, eid, what, item in sorted(steps, key=lambda s: s[:3]):
        if what == 0:
            c = f"case:{eid}"
            while c in alias:
                c = alias[c]
            if c in cases:
                cases[c]["closed"] = True
            continue
        _, _, customer, stage, p, weight, family, entities, tokens, bridges, odd = item
        log_odds = lambda c: sum((t + m) / 2 for t, m in c["worth"].values())
        prob = lambda c: 1 / (1 + math.exp(-(math.log(BASE / (1 - BASE)) + log_odds(c))))
        found = []
        for name, c in sorted(cases.items()):
            sticky = c["customer"] is not None and c["customer"] == customer and c["later"]
            shared = set(tokens) & c["entities"]
            if c["closed"] or not shared or us - c["last"] > (72 * HOUR if sticky else 6 * HOUR):
                continue
            over = shared & set(bridges)
            if sticky or shared - over or len(over) >= 2 or (over & set(odd) and p > BASE and prob(c) > BASE):
                found.append(name)
        if not found and p <= BASE:
            continue
        if not found:
            own = f"case:{eid}"
            cases[own] = {"anchor": customer or min(entities, default=None), "customer": customer, "opened": us, "last": us, "later": False, "entities": set(), "worth": {}, "closed": False}
        else:
            own = min(found, key=lambda n: (-log_odds(cases[n]), cases[n]["opened"], n))
            keep = cases[own]
            for name in found:
                if name == own:
                    continue
                c = cases.pop(name)
                alias[name] = own
                keep["entities"] |= c["entities"]
                keep["opened"], keep["last"], keep["later"] = min(keep["opened"], c["opened"]), max(keep["last"], c["last"]), keep["later"] or c["later"]
                keep["customer"] = keep["customer"] or c["customer"]
                for f, (t, m) in c["worth"].items():
                    a, b = keep["worth"].get(f, (0.0, -math.inf))
                    keep["worth"][f] = (a + t, max(b, m))
            if customer and not (keep["anchor"] or "").startswith("cust:"):
                keep["anchor"] = keep["customer"] = customer
        c = cases[own]
        c["entities"] |= set(entities)
        c["last"] = max(c["last"], us)
        c["later"] = c["later"] or (weight > 0 and stage >= S2)
        a, b = c["worth"].get(family, (0.0, -math.inf))
        c["worth"][family] = (a + weight, max(b, weight))
        of[eid] = own
    for e, c in of.items():
        while c in alias:
            c = alias[c]
        of[e] = c
    ends = {n: (c["anchor"], c["customer"], c["opened"], c["last"]) for n, c in cases.items()}
    return of, ends


def run(spark, items, slice_us=3650 * DAY, closings=None):
    ends = None if closings is None else spark.createDataFrame(closings, "evidence_id string, us long")
    own, found = joiner.join_cases(spark.createDataFrame(items, SCHEMA), slice_us, BASE, ends)
    return {r["evidence_id"]: r["case_id"] for r in own.collect()}, {r["case_id"]: (r["anchor"], r["customer"], r["opened"], r["last"]) for r in found.collect()}


def made(seed, n=160):
    rnd, items = random.Random(seed), []
    for i in range(n):
        c = rnd.randrange(10)
        customer = f"cust:{c}" if rnd.random() < 0.7 else None
        payees = [f"acct:{100 + rnd.randrange(6)}" for _ in range(rnd.randrange(3))]
        own = [t for t in (customer, f"acct:{c}" if rnd.random() < 0.5 else None, f"dev:{rnd.randrange(14)}" if rnd.random() < 0.6 else None, f"ip:{rnd.randrange(9)}" if rnd.random() < 0.3 else None) if t]
        entities = sorted({*own, *payees})
        tokens = [t for t in entities if rnd.random() < 0.9]
        bridges = [t for t in tokens if t in payees]
        items.append((f"e{i:04d}", rnd.randrange(12 * DAY // MINUTE) * MINUTE, customer, rnd.choice([S1, S2, STAGES[6]]), rnd.choice([0.004, 0.01, 0.03, 0.2]), rnd.uniform(-1, 2), rnd.choice(["identity", "device", "transaction"]), entities, tokens, bridges, [t for t in bridges if rnd.random() < 0.4]))
    return items


@pytest.mark.parametrize("seed", [2])
def test_slices_give_what_one_pass_gives(spark, seed):
    items = made(seed)
    closings = [(i[0], i[1] + MINUTE) for i in items[::2]]
    want = brute(items, closings)
    assert len(set(want[0].values())) > 10
    for slice_us in (3650 * DAY, 5 * DAY, 36 * HOUR):
        assert run(spark, items, slice_us, closings) == want
    assert brute(items) != want


def item(i, us, entities, p=0.05, customer=None, stage=S1, weight=1.0, **more):
    return (i, us, customer, stage, p, weight, "identity", entities, entities, more.get("bridges", []), more.get("odd", []))


def test_windows_merges_and_anchors(spark):
    H = HOUR
    cases = lambda items, **more: run(spark, items, **more)[0]
    assert cases([item("a", 0, ["cust:a"], p=0.01), item("b", 1, ["cust:a"]), item("c", 2, ["cust:a"], p=0.01)]) == {"b": "case:b", "c": "case:b"}
    assert cases([item("a", 0, ["cust:a"]), item("b", 6 * H, ["cust:a"]), item("c", 12 * H + MINUTE, ["cust:a"])]) == {"a": "case:a", "b": "case:a", "c": "case:c"}
    sticky = [item("a", 0, ["cust:a"], customer="cust:a", stage=S2), item("b", 72 * H, ["cust:a"], customer="cust:a"), item("c", 145 * H, ["cust:a"], customer="cust:a")]
    assert cases(sticky) == {"a": "case:a", "b": "case:a", "c": "case:c"}
    strong = [item("a", 0, ["ip:x"]), item("b", 1, ["dev:d"], weight=2.0), item("c", 2, ["cust:c", "dev:d", "ip:x"], customer="cust:c")]
    own, found = run(spark, strong)
    assert set(own.values()) == {"case:b"} and found == {"case:b": ("cust:c", "cust:c", 0, 2)}
    assert set(cases([item("a", 0, ["ip:x"]), item("b", 1, ["dev:d"]), item("c", 2, ["dev:d", "ip:x"])]).values()) == {"case:a"}
    assert cases([item("a", 0, ["cust:a"]), item("b", 2, ["cust:a"])], closings=[("a", 1)]) == {"a": "case:a", "b": "case:b"}
    payee = lambda i, us, c, **more: item(i, us, [c, "acct:9"], bridges=["acct:9"], **more)
    assert len(set(cases([payee("a", 0, "cust:a"), payee("b", 1, "cust:b")]).values())) == 2
    assert len(set(cases([payee("a", 0, "cust:a"), payee("b", 1, "cust:b", odd=["acct:9"])]).values())) == 1
    assert run(spark, []) == ({}, {})


def test_the_query_is_the_definition(spark):
    """c2_c4_joined_cases over its whole table."""
    items = case_queries.simple_items(spark, "/root/testdata/sf0.001")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple(r) for r in items.select(*names).collect()]
    want = brute(rows)
    own, found = joiner.join_cases(items)
    assert {r["evidence_id"]: r["case_id"] for r in own.collect()} == want[0]
    assert {r["case_id"]: (r["anchor"], r["customer"], r["opened"], r["last"]) for r in found.collect()} == want[1]


def test_later_events_change_nothing_earlier(spark):
    e = events(spark, "/root/testdata/sf0.001").withColumn("payee", F.when(F.col("k") % 3 == 0, F.concat(F.lit("acct:"), F.col("k") % 5)).otherwise(F.col("payee")))
    cut = e.agg(F.percentile("us", F.lit(0.6))).first()[0]

    def told(rows):
        rows = ordered(rows)
        seen = asof.sightings(rows)
        edges = asof.first_edges(seen)
        asked = rows.where("payee is not null").select(F.col("event_id").alias("ask"), F.col("payee").alias("account"), "o", "us")
        seeds = spark.createDataFrame([("dev:31",), ("acct:4",)], "seed string")
        paths = asof.seed_paths(asof.seed_walks(edges, seeds, asof.excluded_since(edges)), asked)
        both = asof.standing(seen, asked, age_days=5.0).join(paths, "ask", "left").join(asked.select("ask", "us"), "ask").where(F.col("us") <= cut)
        return sorted((tuple(r) for r in both.collect()), key=str)

    whole = told(e)
    assert whole == told(e.where(F.col("us") <= cut)) and len(whole) > 100
    assert {r[-4] for r in whole} >= {1, 2}  # one path, two paths


def test_weakest_edge_of_a_single_path(spark):
    rows = [("acct:1", "dev:1", "LOGGED_IN_FROM", 0.9, 1), ("dev:1", "ip:1", "CONNECTED_VIA", 0.5, 2), ("acct:2", "ip:1", "X", 0.8, 3), ("acct:2", "ip:1", "Y", 0.6, 1), ("acct:3", "ip:1", "X", 0.8, 9)]
    edges = spark.createDataFrame(rows, "src string, dst string, edge_type string, confidence double, since long").withColumn("since", F.col("since").cast(asof.ORDER))
    skip = spark.createDataFrame([("ip:1", 20)], "token string, since long").withColumn("since", F.col("since").cast(asof.ORDER))
    asked = spark.createDataFrame([(1, "acct:2", 2), (2, "acct:2", 3), (3, "acct:3", 8), (4, "acct:3", 9), (5, "acct:3", 20), (6, "acct:1", 0)], "ask long, account string, o long").withColumn("o", F.col("o").cast(asof.ORDER))
    walks = asof.seed_walks(edges, spark.createDataFrame([("acct:1",)], "seed string"), skip)
    got = {r["ask"]: (r["seed_hops"], r["paths"], r["weakest"], r["path"]) for r in asof.seed_paths(walks, asked).collect()}
    assert got == {1: (3, 1, 0.5, ["acct:2", "ip:1", "dev:1", "acct:1"]), 2: (3, 1, 0.5, ["acct:2", "ip:1", "dev:1", "acct:1"]), 4: (3, 1, 0.5, ["acct:3", "ip:1", "dev:1", "acct:1"]), 6: (0, 1, 1.0, ["acct:1"])}


def test_many_edges_take_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST", 0)
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(60)}", f"n{rnd.randrange(60)}") for _ in range(50)]
    over = {}

    def find(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        over[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a string, b string").repartition(6)).collect()}
    assert got == {x: find(x) for x in over if any(x in e for e in edges if e[0] != e[1])}
