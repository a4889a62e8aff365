"""Policy over the fused timeline: the first rule that matches, payment state and step-up requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rules in order of evaluation (id, condition, actions) and severity of actions.
BLOCK, HOLD = "BLOCK_PENDING_PAYMENTS", "HOLD_OUTBOUND_PAYMENTS"
RULES: tuple[tuple[str, dict[str, object], tuple[str, ...]], ...] = (
    ("critical", {"band": "CRITICAL"}, (BLOCK, "FREEZE_NEW_PAYEES", "REVOKE_SESSIONS", "OPEN_CASE_P1")),
    ("ato_new_payee_hold", {"floor": ("floor_S2_THEN_NEW_PAYEE",)}, (HOLD, "STEP_UP_TRUSTED_FACTOR", "OPEN_CASE_P2")),
    ("txn_high_confidence_hold", {"floor": ("floor_TXN_HIGH_CONFIDENCE",)}, (HOLD, "STEP_UP_TRUSTED_FACTOR", "OPEN_CASE_P2")),
    ("app_scam_cooling_off", {"reason": ("APP_SCAM_COOLING_OFF",)}, ("COOLING_OFF_HOLD", HOLD, "SCAM_WARNING", "OPEN_CASE_P2")),
    ("high", {"band": "HIGH"}, (HOLD, "STEP_UP_TRUSTED_FACTOR", "OPEN_CASE_P2")),
    ("app_scam_hold", {"pattern": ("pat_APP_SCAM1",)}, (HOLD, "STEP_UP_TRUSTED_FACTOR", "OPEN_CASE_P2")),
    ("insider_staff_change", {"reason": ("INSIDER_CHANGE_AFTER_NEW_DEVICE_LOGIN",)}, (HOLD, "OPEN_CASE_P1")),
    ("app_scam_warning_medium", {"band": "MEDIUM", "reason": ("APP_SCAM_WARNING",)}, ("SCAM_WARNING", "STEP_UP_ANY_FACTOR")),
    ("medium", {"band": "MEDIUM"}, ("STEP_UP_ANY_FACTOR",)),
    ("app_scam_warning", {"reason": ("APP_SCAM_WARNING",)}, ("SCAM_WARNING", "OPEN_CASE_P2")),
    ("credential_stuffing", {"band": "LOW", "reason": ("CREDENTIAL_STUFFING_IP",)}, ("CAPTCHA_CHALLENGE",)),
    ("distributed_stuffing", {"band": "LOW", "reason": ("ACCOUNT_DISTRIBUTED_FAILURES", "ACCOUNT_LOW_SLOW_FAILURES", "DEVICE_MULTI_ACCOUNT_FAILURES", "GLOBAL_LOGIN_FAILURE_SPIKE")}, ("CAPTCHA_CHALLENGE",)),
    ("session_context_change", {"band": "LOW", "reason": ("SESSION_CONTEXT_CHANGE",)}, ("STEP_UP_ANY_FACTOR",)),
    ("low", {"band": "LOW"}, ("ALLOW",)),
)
SEVERITY = {"ALLOW": 0, "OPEN_CASE_P2": 0, "OPEN_CASE_P1": 0, "CAPTCHA_CHALLENGE": 1, "STEP_UP_ANY_FACTOR": 1, "STEP_UP_TRUSTED_FACTOR": 2, "HOLD_OUTBOUND_PAYMENTS": 2, "FREEZE_NEW_PAYEES": 3, "BLOCK_PENDING_PAYMENTS": 3, "REVOKE_SESSIONS": 3, "SCAM_WARNING": 1, "COOLING_OFF_HOLD": 2}
LATE_DETECTORS = ("cyber", "auth", "kyc")
LATE_EXCLUDED = ("STEP_UP_PASSED_WITH_FRESH_FACTOR", "STEP_UP_FAILED_OR_TIMEOUT", "STEP_UP_PASSED_TRUSTED", "CUSTOMER_DENIED")


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _matches(when: dict[str, object]) -> Column:
    tests = []
    if "band" in when:
        tests.append(F.col("band") == when["band"])
    for name, column in (("reason", "reasons"), ("pattern", "patterns"), ("floor", "floors")):
        if name in when:
            tests.append(F.arrays_overlap(column, _words(when[name])))
    return reduce(lambda a, b: a & b, tests)


def decisions(points: DataFrame) -> DataFrame:
    """Rule, actions, payment state, severity and newly asked step-ups after each point of a timeline.

    Late evidence escalates a hold to a block at the first item that qualifies after a hold; blocked is
    final, so "the first" needs no fold: a running maximum of the state says whether payments were held.
    """
    rule = F.coalesce(*[F.when(_matches(when), F.lit(name)) for name, when, _ in RULES])
    actions = F.coalesce(*[F.when(F.col("rule") == name, _words(acts)) for name, _, acts in RULES])
    rows = points.withColumn("rule", rule).withColumn("actions", actions)
    before = Window.partitionBy("case_id").orderBy("us", "evidence_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.array_contains("actions", BLOCK), 2).when(F.array_contains("actions", HOLD), 1).otherwise(0)
    rows = rows.withColumn("own", own).withColumn("prior", F.coalesce(F.max("own").over(before), F.lit(0)))
    late = F.col("detector").isin(*LATE_DETECTORS) & (F.col("weight") > 0) & ~F.arrays_overlap("reasons", _words(LATE_EXCLUDED)) & F.col("band").isin("HIGH", "CRITICAL")
    rows = rows.withColumn("late", late & (F.col("own") < 2) & (F.col("prior") == 1))
    first = F.col("late") & (F.coalesce(F.max(F.col("late").cast("int")).over(before), F.lit(0)) == 0)
    rows = rows.withColumn("late", first)
    rows = rows.withColumns({
        "actions": F.when(F.col("late"), F.concat("actions", _words((BLOCK,)))).otherwise(F.col("actions")),
        "rule": F.when(F.col("late"), "late_evidence_block").otherwise(F.col("rule")),
        "state": F.max(F.when(F.col("late"), 2).otherwise(F.col("own"))).over(upto),
    })
    worst = F.array_max(F.transform("actions", lambda a: F.element_at(F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair]), a)))
    last = F.coalesce(F.lag("actions").over(Window.partitionBy("case_id").orderBy("us", "evidence_id")), F.array().cast("array<string>"))
    asked = F.array_except(F.filter("actions", lambda a: a.startswith("STEP_UP_")), last)
    return rows.select(
        "case_id", "evidence_id", "us", "stage", "amount", "p_attack", "band", "rule", "actions", worst.alias("severity"),
        F.element_at(_words(("normal", "held", "blocked")), F.col("state") + 1).alias("payment_state"), asked.alias("step_up"),
    )


def replay(decided: DataFrame, hold: int = 2) -> DataFrame:
    """Per case: the first intervention, its lead on the first payment, and the money after it; one pass over the decisions."""
    first = F.min(F.when(F.col("severity") >= hold, F.struct("us", "evidence_id"))).over(Window.partitionBy("case_id"))
    paid = F.col("stage") == "S6_MONETIZATION"
    rows = decided.select("case_id", "us", "amount", paid.alias("paid"), first.alias("e"))
    found = rows.groupBy("case_id").agg(
        F.first("e").alias("e"), F.min(F.when(F.col("paid"), F.col("us"))).alias("paid_us"), F.sum(F.when(F.col("paid") & (F.col("us") >= F.col("e.us")), F.col("amount"))).alias("saved")
    )
    lead = F.floor((F.col("paid_us") - F.col("e.us")) / 1_000_000)
    return found.select("case_id", F.col("e.evidence_id").alias("eip"), F.col("e.us").alias("eip_us"), lead.alias("lead_s"), F.coalesce("saved", F.lit(0)).alias("money_protected"))
