"""Components, case joining, mule signals and payee rules against plain Python and planted cases."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.scalars import DAY, HOUR, MINUTE
from tarnwell.operators import cases, detectors, features, graph
from tarnwell.operators.components import components

NOW = 1_705_276_800_000_000


class Union:
    def __init__(self):
        self.over = {}

    def find(self, x):
        self.over.setdefault(x, x)
        while self.over[x] != x:
            x = self.over[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.over[max(a, b)] = min(a, b)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, 7)]
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.over}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


S1, S2, S5 = "S1_INITIAL_ACCESS", "S2_CONTROL_TAKEOVER", "S5_POSITIONING"
ITEM = "evidence_id long, us long, customer string, stage string, p double, own array<string>, entities array<string>"


def frame(spark, names, kind="token string"):
    return spark.createDataFrame([(n,) for n in names], kind)


def brute_cases(items, excluded, good, odd, base=0.01):
    """The definition, one item after the other."""
    u, last = Union(), {}
    items = sorted(items, key=lambda e: (e[1], e[0]))
    by_id = {e[0]: e for e in items}
    pairs = {}
    for e in items:
        u.find(e[0])
        for t in sorted(set(e[6])):
            bridge = t.startswith("acct:") and t not in e[5]
            if t.split(":")[0] not in cases.KINDS or t in excluded or (bridge and t in good):
                continue
            if t in last:
                f, before = last[t]
                gap = e[1] - by_id[f][1]
                sticky = e[2] is not None and e[2] == by_id[f][2] and by_id[f][3] >= S2 and gap <= cases.STICKY
                if gap <= cases.WINDOW or sticky:
                    pairs.setdefault((f, e[0]), []).append((bridge or before, t))
            last[t] = (e[0], bridge)
    for (a, b), how in pairs.items():
        crossing = [t for c, t in how if c]
        sure = any(t in odd for _, t in how) and by_id[a][4] > base and by_id[b][4] > base
        if len(crossing) < len(how) or len(crossing) >= 2 or sure:
            u.join(a, b)
    groups = {}
    for e in items:
        groups.setdefault(u.find(e[0]), []).append(e)
    out = set()
    for own in groups.values():
        opener = next((i for i, e in enumerate(own) if e[4] > base), None)
        if opener is not None:
            out.add(frozenset(e[0] for e in own[opener:]))
    return out


def joined(spark, items, excluded=(), good=(), odd=()):
    df = spark.createDataFrame(items, ITEM)
    links = cases.links(cases.join_tokens(df, frame(spark, excluded), frame(spark, good)), frame(spark, odd))
    out = {}
    for r in cases.joined(df, links).collect():
        out.setdefault(r["case_id"], set()).add(r["evidence_id"])
    return {frozenset(v) for v in out.values()}


def test_cases_are_those_of_the_definition(spark):
    rnd = random.Random(11)
    items = []
    for i in range(150):
        c = rnd.randrange(12)
        entities = [f"cust:{c}", f"acct:{c}", f"dev:{rnd.randrange(20)}", f"acct:{100 + rnd.randrange(8)}", f"cid:{rnd.randrange(3)}"]
        items.append((i, i * HOUR // 3 + rnd.randrange(HOUR), f"cust:{c}" if i % 9 else None, rnd.choice([S1, S2, S5]), rnd.choice([0.005, 0.02, 0.2]), [f"acct:{c}"], rnd.sample(entities, rnd.randint(1, 5))))
    sets = {"excluded": ["dev:3", "dev:4"], "good": ["acct:100", "acct:5"], "odd": ["acct:101", "acct:102"]}
    assert joined(spark, items, **sets) == brute_cases(items, *map(set, sets.values()))


@pytest.mark.parametrize(("odd", "p", "second", "together"), [((), 0.2, (), False), (("acct:9",), 0.2, (), True), (("acct:9",), 0.005, (), False), ((), 0.2, ("acct:8",), True)])
def test_payees_bridge_cases_only_if_two_or_suspicious(spark, odd, p, second, together):
    items = [(1, 0, "cust:1", S5, 0.2, ["acct:1"], ["cust:1", "acct:1", "acct:9", *second]), (2, HOUR, "cust:2", S5, p, ["acct:2"], ["cust:2", "acct:2", "acct:9", *second])]
    got = joined(spark, items, odd=odd)
    assert (frozenset({1, 2}) in got) == together


def test_cases_close_after_their_window_but_stick_past_a_takeover(spark):
    at = (0, 7 * HOUR, 80 * HOUR)
    def items(stage):  # noqa: E306
        return [(i, t, "cust:1", stage, 0.2, [], ["cust:1"]) for i, t in enumerate(at)]
    assert joined(spark, items(S1)) == {frozenset({0}), frozenset({1}), frozenset({2})}
    assert joined(spark, items(S2)) == {frozenset({0, 1}), frozenset({2})}


def test_items_join_through_neighbours_and_the_nearest_tokens_stay(spark, monkeypatch):
    edges = edges_of(spark, [("acct:1", "dev:1", "LOGGED_IN_FROM", 1, None), ("acct:2", "dev:1", "LOGGED_IN_FROM", 1, None), ("acct:1", "acct:9", "SENT", 1, None), ("acct:3", "acct:9", "SENT", 1, None)])
    near = cases.neighbours(edges, frame(spark, ["acct:1", "acct:2", "acct:3"]), frame(spark, []))
    assert {(r["start"], r["token"], r["hops"], r["direct"]) for r in near.where("start = 'acct:1'").collect()} == {("acct:1", "dev:1", 1, True), ("acct:1", "acct:9", 1, False), ("acct:1", "acct:2", 2, True), ("acct:1", "acct:3", 2, False)}
    items = [(1, 0, "cust:1", S5, 0.2, ["acct:1"], ["cust:1", "acct:1"]), (2, HOUR, "cust:2", S5, 0.2, ["acct:2"], ["cust:2", "acct:2"]), (3, 2 * HOUR, "cust:3", S5, 0.2, ["acct:3"], ["cust:3", "acct:3"])]
    df = spark.createDataFrame(items, ITEM)
    links = lambda tokens: {tuple(r) for r in cases.links(tokens, frame(spark, [])).collect()}
    assert links(cases.join_tokens(df, frame(spark, []), frame(spark, []))) == set()
    tokens = cases.join_tokens(df, frame(spark, []), frame(spark, []), near)
    assert links(tokens) == {(1, 2)}  # by the device; by the payee alone the third stays apart
    monkeypatch.setattr(cases, "MOST_TOKENS", 3)
    kept = {(r["evidence_id"], r["token"]) for r in cases.join_tokens(df, frame(spark, []), frame(spark, []), near).collect()}
    assert kept == {(1, "cust:1"), (1, "acct:1"), (1, "acct:9"), (2, "cust:2"), (2, "acct:2"), (2, "dev:1"), (3, "cust:3"), (3, "acct:3"), (3, "acct:9")}


def edges_of(spark, rows):
    return spark.createDataFrame([(s, d, t, 1.0, f, f if last is None else last) for s, d, t, f, last in rows], "src string, dst string, edge_type string, confidence double, first_seen long, last_seen long")


def test_planted_mules_are_found(spark):
    ago = lambda minutes: NOW - minutes * MINUTE
    rows = [(f"acct:p{i}", "acct:young", "SENT", ago(60 + i), None) for i in range(3)]
    rows += [(f"acct:q{i}", "acct:pass", "SENT", ago(200 + i), None) for i in range(2)] + [("acct:pass", f"acct:out{i}", "SENT", ago(150), None) for i in range(3)] + [("acct:z", "acct:pass", "ADDED_PAYEE", NOW - 40 * DAY, None)]
    rows += [("acct:z", "acct:idle", "SENT", NOW - 50 * DAY, None)] + [(f"acct:r{i}", "acct:idle", "SENT", ago(30), None) for i in range(3)]
    rows += [(f"acct:{x}", "dev:ring", "LOGGED_IN_FROM", NOW - 20 * DAY, None) for x in ("ra", "rb")] + [(f"acct:s{i}", f"acct:r{'ab'[i % 2]}", "SENT", ago(90), None) for i in range(4)]
    rows += [("acct:z", "acct:old", "SENT", NOW - 50 * DAY, NOW - 2 * DAY)]
    found = {r["account"]: r["codes"] for r in graph.mule_signals(edges_of(spark, rows), NOW, frame(spark, ["acct:hub"])).collect()}
    assert found == {
        "acct:young": ["MULE_FAN_IN_NEW_ACCOUNT"], "acct:pass": ["MULE_PASS_THROUGH", "MULE_FAN_OUT"], "acct:idle": ["MULE_DORMANT_ACTIVATED"], "acct:ra": ["MULE_RING"], "acct:rb": ["MULE_RING"],
        **{f"acct:out{i}": ["MULE_RAPID_HOPS"] for i in range(3)},
    }
    assert "acct:young" not in {r["account"] for r in graph.mule_signals(edges_of(spark, rows), NOW, frame(spark, ["acct:young"])).collect()}


def test_seeds_behind_excluded_nodes_are_not_seen(spark):
    rows = [("cust:1", "acct:a", "OWNS", 1, None), ("acct:a", "acct:hub", "SENT", 1, None), ("acct:hub", "acct:seed", "SENT", 1, None), ("acct:a", "acct:b", "SENT", 1, None), ("acct:b", "acct:seed", "SENT", 1, None), ("cust:2", "acct:hub", "OWNS", 1, None)]
    got = graph.seed_distance(edges_of(spark, rows), frame(spark, ["cust:1", "cust:2", "acct:hub", "acct:seed"], "start string"), frame(spark, ["acct:seed"], "seed string"), frame(spark, ["acct:hub"]))
    assert {r["start"]: (r["hops"], r["seed"]) for r in got.collect()} == {"cust:1": (3, "acct:seed"), "acct:hub": (1, "acct:seed"), "acct:seed": (0, "acct:seed")}


PAYEE = "event_id long, kind string, payee string, payee_is_new boolean, payee_fan_in_24h long, payee_passthrough_24h double, reputable boolean, seed_hops int, seed_weakest double, payee_mule array<string>, sender_mule array<string>, name_match boolean, app_level string"


def test_payee_rules(spark):
    row = lambda i, kind="payee_added", new=False, fan=0, flow=0.0, good=False, hops=None, weak=None, mule=None, sender=None, match=True, app=None: (i, kind, "acct:x", new, fan, flow, good, hops, weak, mule, sender, match, app)
    rows = [
        row(1, hops=0), row(2, hops=1, weak=0.5), row(3, hops=1, match=False), row(4, fan=5), row(5, fan=5, good=True), row(6, mule=["MULE_RING"]), row(7, mule=["MULE_RING"], good=True),
        row(8, "transaction", new=True, hops=0), row(9, "transaction", sender=["MULE_PASS_THROUGH", "MULE_RING"]), row(10, "transaction", app="APP_SCAM_WARNING"), row(11, "transaction", app="NONE"), row(12, flow=1.0), row(13, hops=3),
    ]
    got = {r["event_id"]: (round(r["p"], 6), r["reasons"]) for r in detectors.payee_graph(spark.createDataFrame(rows, PAYEE)).collect()}
    assert got == {
        1: (0.3, ["SEED_DISTANCE_0"]), 2: (0.05, ["SEED_DISTANCE_1", "WEAK_PATH_CAP"]), 3: (0.15, ["SEED_DISTANCE_1", "PAYEE_NAME_MISMATCH"]), 4: (0.03, ["MULE_FLOW"]), 6: (0.08, ["MULE_RING"]),
        9: (0.06, ["MULE_PASS_THROUGH"]), 10: (0.02, ["APP_SCAM_WARNING"]), 12: (0.03, ["MULE_FLOW"]), 13: (0.02, ["SEED_DISTANCE_3"]),
    }


def test_scam_signs_add_up(spark):
    df = spark.createDataFrame(
        [(1, True, 12.0, 6, 9999.0, 9999.0, 2.0, ["MULE_RING"], False, 0.9, True, 3.0, True, True), (2, True, 12.0, 6, 9999.0, 9999.0, 2.0, ["MULE_RING"], True, None, None, None, None, None), (3, False, 4.0, 3, 100.0, 2000.0, 30.0, None, None, None, None, 9.0, None, None), (4, True, 12.0, 6, 1.0, 60.0, 2.0, None, None, None, None, None, None, None)],
        "event_id long, first_payment boolean, amount_to_median_30d double, payee_fan_in_24h long, minutes_since_mfa_change double, minutes_since_new_device double, payee_age_days double, payee_mule array<string>, reputable boolean, payee_risk double, pasted boolean, dwell_s double, active_call boolean, remote_access boolean",
    )
    got = {r["event_id"]: (r["score"], r["level"], len(r["signs"])) for r in detectors.app_scam(df).collect()}
    assert got == {1: (2.2, "APP_SCAM_COOLING_OFF", 10), 2: (0.35, "NONE", 2), 3: (0.45, "APP_SCAM_WARNING", 3)}


def test_last_login_with_a_place_counts_for_travel(spark):
    rows = [(1, 0, "login", "c", "success", 10.0, 70.0), (2, HOUR, "login", "c", "success", None, None), (3, 2 * HOUR, "login", "c", "success", 11.0, 70.0)]
    df = spark.createDataFrame(rows, "event_id long, us long, kind string, customer string, result string, lat double, lon double").withColumn("o", F.col("us") * (1 << 21))
    speed = {r["event_id"]: r["travel_speed_kmh"] for r in features.logins(df).collect()}
    assert speed[1] == speed[2] == 0.0 and speed[3] == pytest.approx(111.195 / 2, rel=1e-3)
