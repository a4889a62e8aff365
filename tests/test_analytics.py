"""Upserts, merges, feedback, challenges, local graphs and models against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.scalars import HOUR, MINUTE
from tarnwell.operators import analytics, fusion, models, reports


def test_upserts_in_any_number_of_batches(spark):
    rows = spark.range(200).selectExpr("concat('a', id % 7) src", "concat('b', id % 3) dst", "'SENT' edge_type", "0.5d + (id % 5) / 10 confidence", "id us", "id event_id")
    from tarnwell.operators.graph import merged

    whole = {tuple(r) for r in merged(rows).selectExpr("src", "dst", "confidence", "first_seen", "last_seen", "count", "array_join(cast(ids as array<string>), ',')").collect()}
    out = merged(rows.where("us < 50"))
    for low in (50, 100, 150):
        out = analytics.upserted(out, merged(rows.where(f"us >= {low} and us < {low + 50}")))
    assert {tuple(r) for r in out.selectExpr("src", "dst", "confidence", "first_seen", "last_seen", "count", "array_join(cast(ids as array<string>), ',')").collect()} == whole


def test_merged_cases_hold_all_of_both(spark):
    cases = spark.createDataFrame([("a", ["x", "y"], {"S1": 5, "S2": 9}, 1, 10), ("b", ["y", "z"], {"S1": 3}, 0, 7), ("c", [], {}, 4, 4)], "case_id string, tokens array<string>, stages map<string,long>, opened_us long, last_us long")
    into = spark.createDataFrame([("b", "a")], "case_id string, keep string")
    got = {r["case_id"]: (r["tokens"], r["stages"], r["opened_us"], r["last_us"]) for r in analytics.merged_cases(cases, into).collect()}
    assert got == {"a": (["x", "y", "z"], {"S1": 3, "S2": 9}, 0, 10), "c": (None, None, 4, 4)}


def test_feedback_makes_seeds_of_what_is_not_the_customers(spark):
    verdicts = spark.createDataFrame([("a", "CONFIRMED_FRAUD", 1, ["acct:own", "acct:mule", "dev:d", "ip:1"]), ("b", "FALSE_POSITIVE", 1, ["acct:z"]), ("c", "NOTED", 1, ["acct:q"])], "case_id string, verdict string, us long, tokens array<string>")
    credited = spark.createDataFrame([("a", "auth", 0.9, ["R"]), ("a", "auth", 0.8, ["R"]), ("a", "txn", 0.4, ["R"]), ("a", "graph", 2.0, ["CUSTOMER_DENIED"]), ("b", "txn", 0.6, ["R"]), ("c", "txn", 3.0, ["R"])], "case_id string, detector string, contribution double, reasons array<string>")
    own = spark.createDataFrame([("a", "acct:own")], "case_id string, account string")
    steps, seeds = analytics.feedback(verdicts, credited, own)
    assert {(r["case_id"], r["detector"], r["d_alpha"], r["d_beta"]) for r in steps.collect()} == {("a", "auth", 1.0, 0.0), ("b", "txn", 0.0, 1.0)}
    assert {r["token"] for r in seeds.collect()} == {"acct:mule", "dev:d"}


def test_challenges(spark):
    rows = [("ok", "otp", 0, "sent", 100.0), ("ok", "otp", MINUTE, "wrong", None), ("ok", "otp", 2 * MINUTE, "right", None), ("late", "otp", 0, "sent", 10.0), ("late", "otp", 6 * MINUTE, "right", None), ("bad", "push", 0, "sent", 80.0)]
    rows += [("bad", "push", i * MINUTE, "wrong", None) for i in (1, 2, 3)] + [("bad", "push", 4 * MINUTE, "right", None), ("open", "push", 0, "sent", None)]
    df = spark.createDataFrame(rows, "challenge string, method string, us long, action string, factor_age_h double")
    got = {r["challenge"]: (r["state"], r["factor_trusted"]) for r in analytics.challenges(df, 10 * MINUTE).collect()}
    assert got == {"ok": ("passed", True), "late": ("timeout", False), "bad": ("failed", True), "open": ("pending", False)}
    assert {r["challenge"]: r["state"] for r in analytics.challenges(df, HOUR).collect()}["open"] == "timeout"


def test_proximity_is_pagerank(spark):
    rnd = random.Random(6)
    edges = [(i, j, rnd.random()) for i in range(8) for j in range(i) if rnd.random() < 0.5]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    out = {n: [] for n in nodes}
    for a, b, w in edges:
        out[a].append((b, w))
        out[b].append((a, w))
    score, home = dict.fromkeys(nodes, 0.0), {nodes[0]: 0.5, nodes[1]: 0.5}
    score.update(home)
    for _ in range(20):
        fresh = {n: 0.15 * home.get(n, 0.0) for n in nodes}
        for n in nodes:
            total = sum(w for _, w in out[n])
            for b, w in out[n]:
                fresh[b] += 0.85 * score[n] * w / total
        score = fresh
    got = {r["node"]: r["score"] for r in analytics.proximity(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame([(nodes[0],), (nodes[1],)], "node long")).collect()}
    assert got == {n: pytest.approx(s, abs=1e-9) for n, s in score.items()}


def test_quality_of_scores(spark):
    rnd = random.Random(8)
    rows = [("x", round(rnd.random(), 1), int(rnd.random() < 0.4)) for _ in range(200)]
    r = reports.model_quality(spark.createDataFrame(rows, "part string, p double, y int"), "part").first()
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    roc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert r["roc_auc"] == pytest.approx(roc) and r["positives"] == len(pos)
    ap, seen, tp = 0.0, 0, 0
    for v in sorted({p for _, p, _ in rows}, reverse=True):
        own = [y for _, p, y in rows if p == v]
        seen, tp = seen + len(own), tp + sum(own)
        ap += sum(own) / len(pos) * tp / seen
    assert r["pr_auc"] == pytest.approx(ap)
    one = reports.model_quality(spark.createDataFrame([("x", 0.5, 0)], "part string, p double, y int"), "part").first()
    assert one["pr_auc"] is None and one["roc_auc"] is None and one["ece"] == 0.5


def test_models_learn_and_are_calibrated(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.random(), rnd.random(), None if i % 50 == 0 else rnd.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double").withColumn("y", ((F.col("a") + F.col("b") > 1.4) & (F.col("i") % 10 < 9)).cast("int"))
    for trees in (False, True):
        scorer = models.fitted(df.where("i < 900"), df.where("i between 900 and 1199"), ("a", "b", "c"), trees=trees)
        r = models.report(scorer, df.where("i >= 1200")).first()
        assert r["roc_auc"] > 0.9 and r["ece"] < 0.1
        assert scorer.scored(df).where("p < 0.0001 or p > 0.9999").count() == 0


def test_cloud_action_from_an_ip_of_the_case(spark):
    """A cloud item whose ip an earlier positive item of its case has shown adds its bonus once."""
    def item(i, case, detector, p, ips):
        return (i, case, i, "x", detector, fusion.FAMILY[detector], "S4_ESCALATION", p, 0.5, ["R"], None, ips)
    rows = [item(1, "a", "auth", 0.2, ["ip:1", "dev:1"]), item(2, "a", "cyber", 0.2, ["ip:1"]), item(3, "a", "cyber", 0.2, ["ip:1"]), item(4, "b", "cyber", 0.2, ["ip:1"]), item(5, "b", "cyber", 0.2, ["ip:2"]), item(6, "c", "auth", 0.004, ["ip:3"]), item(7, "c", "cyber", 0.2, ["ip:3"])]
    from .test_engine import SCHEMA

    points = {r["evidence_id"]: r for r in fusion.timeline(spark.createDataFrame(rows, SCHEMA + ", entities array<string>")).collect()}
    assert {i: "pat_CASE_IP_CLOUD" in r["patterns"] for i, r in points.items()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
