"""The floor of a confident payment model, and the rule that hangs on it."""

from tarnwell.operators import fusion, policy

from .test_engine import SCHEMA


def test_confident_payment_is_held(spark):
    def item(i, case, detector, stage, p, reason, degraded=False):
        return (i, case, i, "x", detector, fusion.FAMILY[detector], stage, p, 0.1, [reason], None, degraded)

    rows = [
        item(1, "sure", "txn", "S6_MONETIZATION", 0.90, "R"), item(2, "sure", "auth", "S2_CONTROL_TAKEOVER", 0.004, "STEP_UP_PASSED_TRUSTED"), item(3, "sure", "txn", "S6_MONETIZATION", 0.95, "R"),
        item(4, "less", "txn", "S6_MONETIZATION", 0.89, "R"), item(5, "rule", "txn", "S6_MONETIZATION", 0.95, "R", True), item(6, "other", "graph", "S5_POSITIONING", 0.95, "R"),
    ]
    points = fusion.timeline(spark.createDataFrame(rows, SCHEMA + ", degraded boolean"))
    floors = {r["evidence_id"]: ("floor_TXN_HIGH_CONFIDENCE" in r["floors"], r["band"]) for r in points.collect()}
    assert floors == {1: (True, "HIGH"), 2: (False, "LOW"), 3: (True, "HIGH"), 4: (False, "LOW"), 5: (False, "LOW"), 6: (False, "LOW")}
    held = {r["evidence_id"]: r["rule"] for r in policy.decisions(points).collect()}
    assert held[1] == held[3] == "txn_high_confidence_hold" and held[2] == held[5] == "low"
