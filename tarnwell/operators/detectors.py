"""Rule detectors: features in, evidence out. A detector is a function DataFrame -> DataFrame.

Several rules of one detector on one event give one item: the highest p, all reasons by falling p.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ist_hour
from .fusion import FAMILY, RELIABILITY
from .graph import MULE_P

#: An item below this p is not emitted, but for these reasons; p stays inside these bounds.
LEAST, ALWAYS, BOUNDS = 0.02, ("STEP_UP_PASSED_TRUSTED", "CUSTOMER_DENIED"), (1e-4, 1 - 1e-4)


def rule(condition: Column, code: str, p: float | Column) -> Column:
    p = p if isinstance(p, Column) else F.lit(p)
    return F.when(condition, F.struct(p.cast("double").alias("p"), F.lit(code).alias("code")))


def emitted(rows: DataFrame, detector: str, stage: str, rules: list[Column], *keep: str) -> DataFrame:
    """(event_id, detector, family, stage, p, reliability, reasons, kept columns) where a rule fires."""
    a, b = RELIABILITY[detector]
    hits = F.array_sort(F.array_compact(F.array(*rules)), lambda x, y: F.when(x["p"] > y["p"], -1).when(x["p"] < y["p"], 1).when(x["code"] < y["code"], -1).otherwise(1))
    found = rows.withColumn("hits", hits).where("size(hits) > 0")
    p = F.greatest(F.lit(BOUNDS[0]), F.least(F.lit(BOUNDS[1]), F.get("hits", F.lit(0))["p"]))
    reasons = F.transform("hits", lambda h: h["code"])
    found = found.select("event_id", *keep, F.lit(detector).alias("detector"), F.lit(FAMILY[detector]).alias("family"), F.lit(stage).alias("stage"), p.alias("p"), F.lit(a / (a + b)).alias("reliability"), reasons.alias("reasons"))
    return found.where((F.col("p") >= LEAST) | F.arrays_overlap("reasons", F.array(*[F.lit(c) for c in ALWAYS])))


def stuffing(rows: DataFrame, customers: int = 10, failures: int = 5, sources: int = 3, day_failures: int = 6, day_ips: int = 4, per_ip: int = 2, device_accounts: int = 4, device_failures: int = 3) -> DataFrame:
    """Credential stuffing on a failed login, from the ip, the account by number or by stealth, or the device."""
    boost = F.when(F.col("global_spike"), 1.5).otherwise(1.0)
    return emitted(rows.where("result = 'failure'"), "netsec", "S0_RECON", [
        rule(F.col("ip_failed_customers_1h") >= customers, "CREDENTIAL_STUFFING_IP", 0.04),
        rule((F.col("acct_fail_1h") >= failures) & (F.col("acct_fail_sources_1h") >= sources), "ACCOUNT_DISTRIBUTED_FAILURES", 0.04 * boost),
        rule((F.col("acct_fail_24h") >= day_failures) & (F.col("acct_fail_ips_24h") >= day_ips) & F.col("acct_max_fail_per_ip_24h").between(1, per_ip), "ACCOUNT_LOW_SLOW_FAILURES", 0.03 * boost),
        rule((F.col("dev_accounts_1h") >= device_accounts) & (F.col("dev_fail_1h") >= device_failures), "DEVICE_MULTI_ACCOUNT_FAILURES", 0.05 * boost),
        rule(F.col("global_spike"), "GLOBAL_LOGIN_FAILURE_SPIKE", 0.03),
    ])


def travel(rows: DataFrame, speed: float = 900.0) -> DataFrame:
    return emitted(rows, "behaviour", "S1_INITIAL_ACCESS", [rule(F.col("travel_speed_kmh") > speed, "IMPOSSIBLE_TRAVEL", 0.08)])


def given(rows: DataFrame, name: str, kind: str) -> Column:
    """A column of ``rows``, or null where the source of events does not carry it."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


#: The p of account-control rules, and of session and client rules.
AUTH_P = {
    "MFA_CHANGED_AFTER_NEW_DEVICE": 0.06, "PROFILE_CHANGE_AFTER_NEW_DEVICE": 0.05, "MFA_FAIL_THEN_PASS": 0.04, "PUSH_SPAM": 0.06, "RECENT_SIM_SWAP": 0.07,
    "STEP_UP_PASSED_WITH_FRESH_FACTOR": 0.08, "STEP_UP_FAILED_OR_TIMEOUT": 0.05, "STEP_UP_PASSED_TRUSTED": 0.003, "CUSTOMER_DENIED": 0.01,
}
TZ_P, DEVICE_ONE_P, DEVICE_MANY_P, SESSION_P, ANONYMISER_P, ANONYMISER_BIT = 0.02, 0.03, 0.05, 0.05, 0.08, 64


def session_change(rows: DataFrame) -> Column:
    """A session whose network and device context changed together, stronger if to an anonymiser."""
    p = F.when(given(rows, "session_change_mask", "int").bitwiseAND(F.lit(ANONYMISER_BIT)) > 0, ANONYMISER_P).otherwise(SESSION_P)
    return rule(F.coalesce(given(rows, "session_change", "boolean"), F.lit(False)), "SESSION_CONTEXT_CHANGE", p)


def device_inconsistent(rows: DataFrame, also: Column) -> Column:
    """A device that shows other than it says, by how many contradictions."""
    n = F.bit_count(F.coalesce(given(rows, "device_inconsistency_mask", "int"), F.lit(0)))
    return rule((n > 0) & also, "DEVICE_INCONSISTENT", F.when(n >= 2, DEVICE_MANY_P).otherwise(DEVICE_ONE_P))


def login_context(rows: DataFrame) -> DataFrame:
    """Logins whose browser's zone is not the network's, whose device contradicts itself, or whose session changed hands."""
    return emitted(rows.where("kind = 'login'"), "behaviour", "S1_INITIAL_ACCESS", [
        rule(F.coalesce(given(rows, "tz_mismatch", "boolean"), F.lit(False)), "TZ_MISMATCH", TZ_P),
        device_inconsistent(rows, F.lit(True)),
        session_change(rows),
    ])


def account_control(rows: DataFrame, minutes: float = 60.0, fails: int = 2, pushes: int = 3, sim_hours: float = 72.0, trusted_hours: float = 72.0) -> DataFrame:
    """Signs that someone takes control of an account.

    MFA or profile changed soon after a new device, challenges failed then passed, push spam, a recent SIM
    change, the results of a step-up by the age of its factor, and a session whose context changed. A
    device that contradicts itself only supports another of these. On payees, payments and identity checks
    only the session rules hold, on results of a step-up all others do.
    """
    is_a = lambda *kinds: F.col("kind").isin(*kinds)
    new_device = F.coalesce(F.col("minutes_since_new_device") <= minutes, F.lit(False))
    step, age, result = is_a("step_up_result"), given(rows, "factor_age_h", "double"), F.col("result")
    passed, fresh = step & (result == "passed"), F.coalesce(age < trusted_hours, F.lit(False))
    named = {
        "MFA_CHANGED_AFTER_NEW_DEVICE": is_a("mfa_change") & new_device,
        "PROFILE_CHANGE_AFTER_NEW_DEVICE": is_a("profile_change") & new_device,
        "MFA_FAIL_THEN_PASS": is_a("mfa_challenge") & (result == "passed") & (F.col("mfa_fails_15m") >= fails),
        "PUSH_SPAM": is_a("mfa_challenge") & (F.col("push_rejects_10m") >= pushes),
        "RECENT_SIM_SWAP": is_a("sim_signal") & (given(rows, "sim_change_age_h", "double") < sim_hours),
        "STEP_UP_PASSED_WITH_FRESH_FACTOR": passed & fresh,
        "STEP_UP_PASSED_TRUSTED": passed & ~fresh,
        "STEP_UP_FAILED_OR_TIMEOUT": step & result.isin("failed", "timeout") & ~fresh,
        "CUSTOMER_DENIED": step & (result == "denied_by_customer"),
    }
    hits = [rule(F.coalesce(c, F.lit(False)), code, AUTH_P[code]) for code, c in named.items()]
    changed = session_change(rows)
    other = F.size(F.array_compact(F.array(*hits))) > 0
    only_session = is_a("payee_added", "transaction", "kyc_result")
    supported = device_inconsistent(rows, F.when(only_session, changed.isNotNull()).otherwise(other))
    return emitted(rows, "auth", "S2_CONTROL_TAKEOVER", [*[F.when(~only_session, h) for h in hits], F.when(~step, changed), F.when(~step, supported)])


#: Actions of staff that move control or money, and the p of their rules.
SENSITIVE = ("UpdateTransferLimit", "ResetCustomerMfa", "UpdateCustomerPhone", "UpdateCustomerEmail", "DisableTransactionAlerts", "AddPayeeOnBehalf", "UnlockAccount")
INSIDER_P = {"INSIDER_CHANGE_AFTER_NEW_DEVICE_LOGIN": 0.04, "INSIDER_REPEATED_SENSITIVE_ACTIONS": 0.03, "INSIDER_SENSITIVE_OFF_HOURS": 0.02}


def insider(rows: DataFrame, least: int = 3, off_from: int = 21, off_to: int = 7) -> DataFrame:
    """Sensitive actions of staff: after a login from a new device of a customer with an established one
    (new_device_login), across many customers (customers_60m), and, beside one of these, out of hours."""
    ours = rows.where(F.col("action").isin(*SENSITIVE) & (F.coalesce(F.col("result"), F.lit("")) != "failure"))
    after, many = F.coalesce(F.col("new_device_login"), F.lit(False)), F.coalesce(F.col("customers_60m") >= least, F.lit(False))
    hour = F.floor(ist_hour(F.col("us")))
    off = (after | many) & ((hour >= off_from) | (hour < off_to))
    return emitted(ours, "cyber", "S4_ESCALATION", [rule(c, code, INSIDER_P[code]) for code, c in zip(INSIDER_P, (after, many, off), strict=True)])


#: The p of the nearest seed by its distance, of a path over a weak edge, and of all signs of one payee.
SEED_P, WEAK_P, WEAK_EDGE, GRAPH_CAP, FLOW_FACTOR, FLOW_LEAST = (0.30, 0.10, 0.05, 0.02), 0.05, 0.7, 0.30, 1.5, 0.03


def payee_graph(rows: DataFrame, fan_in: int = 5, between: tuple[float, float] = (0.8, 1.2)) -> DataFrame:
    """What the graph says of the payee (and of the sender) of a payment or an added payee.

    Needs kind, payee_is_new, payee_fan_in_24h, payee_passthrough_24h, reputable, seed_hops, seed_weakest (null
    without a path or with more than one), payee_mule and sender_mule (arrays of codes), and, where known,
    name_match and app_level. A payment right after its payee was added has its payee judged then.
    """
    judged = ~((F.col("kind") == "transaction") & F.coalesce(F.col("payee_is_new"), F.lit(False)))
    reputable = F.coalesce(F.col("reputable"), F.lit(False))
    weak = F.coalesce((F.col("seed_hops") > 0) & (F.col("seed_weakest") < WEAK_EDGE), F.lit(False))
    seed = F.get(F.array(*map(F.lit, SEED_P)), F.col("seed_hops"))
    seed = F.coalesce(F.when(weak, F.least(seed, F.lit(WEAK_P))).otherwise(seed), F.lit(0.0))
    mismatch = (F.col("kind") == "payee_added") & ~F.coalesce(given(rows, "name_match", "boolean"), F.lit(True))
    flow = ((F.col("payee_fan_in_24h") >= fan_in) | F.col("payee_passthrough_24h").between(*between)) & ~reputable
    p = seed
    for hit in (mismatch, flow):
        p = F.when(F.coalesce(hit, F.lit(False)), F.greatest(p * FLOW_FACTOR, F.lit(FLOW_LEAST))).otherwise(p)
    worth = lambda codes: F.coalesce(F.array_max(F.transform(codes, lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in MULE_P.items() for x in kv]), c))), F.lit(0.0))
    mine = F.when(reputable, F.array().cast("array<string>")).otherwise(F.coalesce(F.col("payee_mule"), F.array().cast("array<string>")))
    theirs = F.array_except(F.coalesce(F.filter("sender_mule", lambda c: c.isin("MULE_PASS_THROUGH", "MULE_FAN_OUT")), F.array().cast("array<string>")), F.when(judged, mine).otherwise(F.array().cast("array<string>")))
    level = F.nullif(given(rows, "app_level", "string"), F.lit("NONE"))
    sent = F.col("kind") == "transaction"
    p = F.when(judged, F.greatest(p, worth(mine))).otherwise(0.0)
    p = F.greatest(p, F.when(sent, worth(theirs)).otherwise(0.0), F.when(sent & level.isNotNull(), APP_P).otherwise(0.0))
    own = [F.when(F.col("seed_hops").isNotNull(), F.concat(F.lit("SEED_DISTANCE_"), F.col("seed_hops"))), F.when(weak, F.lit("WEAK_PATH_CAP")), F.when(mismatch, F.lit("PAYEE_NAME_MISMATCH")), F.when(flow, F.lit("MULE_FLOW"))]
    reasons = F.concat(F.when(judged, F.concat(F.array_compact(F.array(*own)), mine)).otherwise(F.array().cast("array<string>")), F.when(sent, F.concat(theirs, F.array_compact(F.array(level)))).otherwise(F.array().cast("array<string>")))
    a, b = RELIABILITY["graph"]
    found = rows.where("payee is not null").select(
        "event_id", F.lit("graph").alias("detector"), F.lit(FAMILY["graph"]).alias("family"), F.lit("S5_POSITIONING").alias("stage"),
        F.greatest(F.lit(BOUNDS[0]), F.least(p, F.lit(GRAPH_CAP))).alias("p"), F.lit(a / (a + b)).alias("reliability"), reasons.alias("reasons"),
    )
    return found.where("size(reasons) > 0").where(F.col("p") >= LEAST)


def payments(rows: DataFrame) -> DataFrame:
    """The rule that stands in for the payment model, and transfers split just under a limit."""
    high = (F.col("amount_to_median_30d") > 5) & F.col("payee_is_new")
    near = F.col("tw_near_limit_count_24h") >= 2
    split = near & (F.col("tw_near_limit_limit_paise") > 0) & (F.col("tw_near_limit_same_limit_max_24h") >= 2) & (F.col("tw_pair_sum_24h_paise") >= F.col("tw_near_limit_limit_paise"))
    return emitted(rows, "txn", "S6_MONETIZATION", [
        rule(high, "DEGRADED_HIGH", 0.15),
        rule(~high, "DEGRADED_LOW", 0.005),
        rule(near, "STRUCTURING", F.when(split, 0.30).otherwise(0.12)),
    ], "amount")


#: The weight of each sign of a scam, and the p of a warning.
APP_WEIGHTS = {
    "APP_FIRST_PAYMENT_TO_PAYEE": 0.10, "APP_AMOUNT_ABOVE_BASELINE": 0.15, "APP_AMOUNT_FAR_ABOVE_BASELINE": 0.25, "APP_YOUNG_PAYEE_ACCOUNT": 0.10, "APP_PAYEE_FAN_IN_UNRELATED": 0.20, "APP_PAYEE_FAN_IN_BURST": 0.35, "APP_PAYEE_MULE_SIGNAL": 0.15,
    "APP_PAYEE_REPORTED": 0.40, "APP_RECENT_SECURITY_CHANGE": 0.10, "APP_PASTED_PAYEE_DETAILS": 0.15, "APP_RUSHED_PAYMENT": 0.05, "APP_ACTIVE_CALL_DEMO": 0.30, "APP_REMOTE_ACCESS_DEMO": 0.35,
}
APP_P = 0.02


def app_scam(rows: DataFrame, warn: float = 0.45, cool: float = 0.70) -> DataFrame:
    """(event_id, score, level, signs): weighted signs of a payment that the victim makes; silent on a device
    of the last 24 h, which is the takeover path.

    Signs of the payee do not count where it is reputable. Columns that a source does not carry
    (payee_age_days, payee_mule, reputable, payee_risk, pasted, dwell_s, active_call, remote_access) give no sign.
    """
    ratio, fan = F.col("amount_to_median_30d"), F.col("payee_fan_in_24h")
    unknown = ~F.coalesce(given(rows, "reputable", "boolean"), F.lit(False))
    when = {
        "APP_FIRST_PAYMENT_TO_PAYEE": F.col("first_payment"),
        "APP_AMOUNT_FAR_ABOVE_BASELINE": ratio >= 10,
        "APP_AMOUNT_ABOVE_BASELINE": (ratio >= 3) & (ratio < 10),
        "APP_YOUNG_PAYEE_ACCOUNT": unknown & (given(rows, "payee_age_days", "double") < 7),
        "APP_PAYEE_FAN_IN_BURST": unknown & (fan >= 5),
        "APP_PAYEE_FAN_IN_UNRELATED": unknown & (fan >= 2) & (fan < 5),
        "APP_PAYEE_MULE_SIGNAL": unknown & (F.size(F.coalesce(given(rows, "payee_mule", "array<string>"), F.array().cast("array<string>"))) > 0),
        "APP_PAYEE_REPORTED": given(rows, "payee_risk", "double") >= 0.5,
        "APP_RECENT_SECURITY_CHANGE": F.least("minutes_since_mfa_change", "minutes_since_new_device") < 72 * 60,
        "APP_PASTED_PAYEE_DETAILS": given(rows, "pasted", "boolean"),
        "APP_RUSHED_PAYMENT": given(rows, "dwell_s", "double") < 5,
        "APP_ACTIVE_CALL_DEMO": given(rows, "active_call", "boolean"),
        "APP_REMOTE_ACCESS_DEMO": given(rows, "remote_access", "boolean"),
    }
    held = {code: F.coalesce(c, F.lit(False)) for code, c in when.items()}
    score = F.round(sum((F.when(c, APP_WEIGHTS[code]).otherwise(0.0) for code, c in held.items()), F.lit(0.0)), 4)
    signs = F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in held.items()]))
    rows = rows.where(F.col("minutes_since_new_device") >= 24 * 60).withColumns({"score": score, "signs": signs})
    level = F.when(F.col("score") >= cool, "APP_SCAM_COOLING_OFF").when(F.col("score") >= warn, "APP_SCAM_WARNING").otherwise("NONE")
    return rows.select("event_id", "score", level.alias("level"), "signs")


def identity_checks(rows: DataFrame) -> DataFrame:
    """Weak liveness, face match or document, or a suspected injection."""
    return emitted(rows, "kyc", "S3_IDENTITY_MANIPULATION", [
        rule(F.col("liveness_score") < 0.5, "LOW_LIVENESS", 0.06),
        rule(F.col("face_match_score") < 0.7, "LOW_FACE_MATCH", 0.05),
        rule(F.col("doc_tamper_score") > 0.5, "DOC_TAMPER", 0.06),
        rule(F.col("injection_suspected"), "INJECTION_SUSPECTED", 0.12),
    ])


def ids_alerts(rows: DataFrame) -> DataFrame:
    """Alerts of the network sensor by severity."""
    p = F.least(F.lit(0.05), F.when(F.col("severity") == 1, 0.05).when(F.col("severity") == 2, 0.03).otherwise(0.015))
    code = F.concat(F.lit("IDS_SEV"), F.col("severity").cast("string"))
    return emitted(rows.withColumn("code", code), "netsec", "S0_RECON", [F.struct(p.alias("p"), F.col("code").alias("code"))])


def cloud_audit(rows: DataFrame) -> DataFrame:
    """Console actions: limit raised or MFA reset from an untrusted ip, profiles read in bulk."""
    outside = ~F.col("src_ip_trusted")
    hits = {"S4_ESCALATION": rule((F.col("action") == "UpdateTransferLimit") & outside, "cloud_limit_raise_untrusted_ip", 0.04),
            "S0_RECON": rule((F.col("action") == "ReadCustomerProfile") & (F.col("actor_type") == "support_console") & (F.col("reads_10m") >= 20), "bulk_profile_read_support_console", 0.03),
            "S2_CONTROL_TAKEOVER": rule((F.col("action") == "ResetCustomerMfa") & outside, "mfa_reset_by_support_untrusted_ip", 0.05)}
    found = [emitted(rows, "cyber", stage, [hit]) for stage, hit in hits.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])
