"""Fusion, policy, replay and metric queries.

Their evidence is a simple function of every event (see :func:`evidence`) in which every band, floor, pattern
and policy rule occurs, so that the SQL can restate the fusion itself prefix by prefix with self-joins. The chain from
detectors to decisions is in :mod:`case_queries`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import correlation, features, fusion, patterns, policy
from ..sources.bridge import EVENTS_SQL, events, ordered
from .registry import query


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per event. A customer's cases are spans of 1, 2, 4 or 8 days, so that some have two items and
    some twenty, and one customer in eight does in an hour what others do in eight days; all bands, floors,
    patterns and policy rules occur among them."""
    e, k = events(spark, sf_dir), F.col("k")
    login, paid = F.col("kind") == "login", F.col("kind") == "transaction"
    detector = F.when(paid, "txn").when(F.col("kind") == "payee_added", "graph").when(login, F.when(F.col("result") == "success", "behaviour").otherwise("netsec")).when((F.col("kind") == "mfa_change") & (k % 5 == 0), "cyber").otherwise("auth")
    is_ = lambda name: F.col("detector") == name
    stage = F.when(is_("txn"), "S6_MONETIZATION").when(is_("graph"), "S5_POSITIONING").when(is_("behaviour"), "S1_INITIAL_ACCESS").when(is_("netsec"), "S0_RECON").when(is_("cyber"), "S4_ESCALATION").otherwise("S2_CONTROL_TAKEOVER")
    reason = (
        F.when(is_("graph") & (k % 4 == 0), "PAYEE_NAME_MISMATCH").when(is_("graph") & (k % 16 == 5), "SEED_DISTANCE_0")
        .when(is_("auth") & (k % 50 == 7), "CUSTOMER_DENIED").when(is_("auth") & (k % 9 == 1), "STEP_UP_PASSED_TRUSTED").when(is_("auth") & (k % 13 == 4), "INSIDER_CHANGE_AFTER_NEW_DEVICE_LOGIN")
        .when(is_("txn") & (k % 12 == 5), "APP_SCAM_WARNING").when(is_("txn") & (k % 12 == 7), "APP_SCAM_COOLING_OFF")
        .when(is_("netsec") & (k % 3 == 0), "CREDENTIAL_STUFFING_IP").when(is_("netsec") & (k % 3 == 1), "ACCOUNT_DISTRIBUTED_FAILURES")
        .when(is_("behaviour") & (k % 6 == 2), "SESSION_CONTEXT_CHANGE").otherwise("RULE")
    )
    family = F.element_at(F.create_map(*[F.lit(x) for pair in fusion.FAMILY.items() for x in pair]), F.col("detector"))
    trust = F.element_at(F.create_map(*[F.lit(x) for d, (a, b) in fusion.RELIABILITY.items() for x in (d, a / (a + b))]), F.col("detector"))
    number = F.substring("customer", 6, 20).cast("long")
    days = F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), (number % 4 + 1).cast("int"))
    span = 8 * 86_400_000_000
    hurried = F.when(number % 8 == 3, F.col("us") - F.col("us") % span + F.floor(F.col("us") % span / 200)).otherwise(F.col("us"))
    p = F.when(k % 25 == 24, 0.93).when(k % 25 == 12, 0.3).otherwise(0.002 + (k % 23) * 0.0021) + (F.col("event_id") % 997) * 0.000001
    return e.withColumn("detector", detector).select(
        F.col("event_id").alias("evidence_id"), F.concat(F.lit("case:"), number * 100_000 + F.floor(F.col("us") / (days * 86_400_000_000))).alias("case_id"), hurried.alias("us"), "customer", "detector", family.alias("family"), stage.alias("stage"),
        p.alias("p"), trust.alias("reliability"), F.array(reason).alias("reasons"), "amount", F.array("ip").alias("entities"),
    )


EVIDENCE = f"""WITH {EVENTS_SQL},
d AS (SELECT *, CASE kind WHEN 'transaction' THEN 'txn' WHEN 'payee_added' THEN 'graph' WHEN 'login' THEN CASE WHEN result = 'success' THEN 'behaviour' ELSE 'netsec' END ELSE CASE WHEN kind = 'mfa_change' AND k % 5 = 0 THEN 'cyber' ELSE 'auth' END END AS detector, CAST(substr(customer, 6) AS BIGINT) AS cn FROM ev),
item AS (SELECT event_id AS evidence_id, 'case:' || (cn * 100000 + us // (86400000000 * [1, 2, 4, 8][cn % 4 + 1])) AS case_id, CASE WHEN cn % 8 = 3 THEN us - us % 691200000000 + us % 691200000000 // 200 ELSE us END AS us, detector, amount, ip,
  CASE detector WHEN 'txn' THEN 'transaction' WHEN 'behaviour' THEN 'identity' WHEN 'auth' THEN 'device' WHEN 'netsec' THEN 'cyber' WHEN 'cyber' THEN 'cyber' ELSE 'graph' END AS family,
  CASE detector WHEN 'txn' THEN 'S6_MONETIZATION' WHEN 'graph' THEN 'S5_POSITIONING' WHEN 'behaviour' THEN 'S1_INITIAL_ACCESS' WHEN 'netsec' THEN 'S0_RECON' WHEN 'cyber' THEN 'S4_ESCALATION' ELSE 'S2_CONTROL_TAKEOVER' END AS stage,
  CASE WHEN detector = 'graph' AND k % 4 = 0 THEN 'PAYEE_NAME_MISMATCH' WHEN detector = 'graph' AND k % 16 = 5 THEN 'SEED_DISTANCE_0'
    WHEN detector = 'auth' AND k % 50 = 7 THEN 'CUSTOMER_DENIED' WHEN detector = 'auth' AND k % 9 = 1 THEN 'STEP_UP_PASSED_TRUSTED' WHEN detector = 'auth' AND k % 13 = 4 THEN 'INSIDER_CHANGE_AFTER_NEW_DEVICE_LOGIN'
    WHEN detector = 'txn' AND k % 12 = 5 THEN 'APP_SCAM_WARNING' WHEN detector = 'txn' AND k % 12 = 7 THEN 'APP_SCAM_COOLING_OFF'
    WHEN detector = 'netsec' AND k % 3 = 0 THEN 'CREDENTIAL_STUFFING_IP' WHEN detector = 'netsec' AND k % 3 = 1 THEN 'ACCOUNT_DISTRIBUTED_FAILURES' WHEN detector = 'behaviour' AND k % 6 = 2 THEN 'SESSION_CONTEXT_CHANGE' ELSE 'RULE' END AS reason,
  CASE k % 25 WHEN 24 THEN 0.93::DOUBLE WHEN 12 THEN 0.3::DOUBLE ELSE 0.002::DOUBLE + (k % 23) * 0.0021::DOUBLE END + (event_id % 997) * 0.000001::DOUBLE AS p,
  CASE detector WHEN 'txn' THEN 0.85 WHEN 'behaviour' THEN 0.6 WHEN 'auth' THEN 0.7 WHEN 'netsec' THEN 0.5 WHEN 'cyber' THEN 0.5 ELSE 0.8 END AS r FROM d WHERE true),
w AS (SELECT *, CAST(r AS DOUBLE) * greatest(-2.0, least(3.0, ln(p / (1 - p)) - ln(0.01::DOUBLE / 0.99))) AS ell, row_number() OVER (PARTITION BY case_id ORDER BY us, evidence_id) AS k FROM item)"""

PREFIX = EVIDENCE + """,
pre AS (SELECT a.case_id, a.k AS upto, a.us AS now, b.*, row_number() OVER (PARTITION BY a.case_id, a.k, b.family ORDER BY b.ell DESC, b.us, b.evidence_id) AS rank FROM w a JOIN w b ON a.case_id = b.case_id AND b.k <= a.k),
s AS (SELECT case_id, upto, sum(CASE WHEN rank = 1 THEN ell ELSE 0.5 * ell END) AS total, sum(CASE WHEN stage = 'S6_MONETIZATION' THEN amount ELSE 0 END) AS amount FROM pre GROUP BY 1, 2),
ato1 AS (SELECT b.case_id, min(b.k) AS k FROM w b JOIN w a ON a.case_id = b.case_id AND a.k < b.k AND a.ell > 0 AND b.ell > 0 AND a.stage = 'S1_INITIAL_ACCESS' AND b.stage = 'S2_CONTROL_TAKEOVER' AND b.us - a.us <= 1800000000 GROUP BY 1),
ato2 AS (SELECT c.case_id, min(c.k) AS k FROM w a JOIN w b ON a.case_id = b.case_id AND a.k < b.k AND b.us - a.us <= 86400000000 JOIN w c ON c.case_id = b.case_id AND b.k < c.k AND c.us - b.us <= 86400000000 AND c.us - a.us <= 86400000000
  WHERE a.ell > 0 AND b.ell > 0 AND c.ell > 0 AND a.stage = 'S1_INITIAL_ACCESS' AND b.stage = 'S2_CONTROL_TAKEOVER' AND c.stage = 'S5_POSITIONING' GROUP BY 1),
app AS (SELECT b.case_id, min(b.k) AS k FROM w b JOIN w a ON a.case_id = b.case_id AND a.k < b.k AND a.ell > 0 AND b.ell > 0 AND a.stage = 'S5_POSITIONING' AND a.reason = 'PAYEE_NAME_MISMATCH' AND b.stage = 'S6_MONETIZATION' AND b.us - a.us <= 1800000000 GROUP BY 1),
s2 AS (SELECT case_id, min(k) AS k FROM w WHERE stage = 'S2_CONTROL_TAKEOVER' AND ell > 0 GROUP BY 1),
firsts AS (SELECT case_id, stage, min(k) AS k, min(us) AS us FROM w WHERE ell > 0 GROUP BY 1, 2),
three AS (SELECT a.case_id, min(greatest(a.k, b.k, c.k)) AS k FROM firsts a JOIN firsts b ON a.case_id = b.case_id AND a.stage < b.stage JOIN firsts c ON c.case_id = b.case_id AND b.stage < c.stage
  WHERE greatest(a.us, b.us, c.us) - least(a.us, b.us, c.us) <= 1800000000 GROUP BY 1),
pairs AS (SELECT b.case_id, b.k, a.us FROM w b JOIN w a ON a.case_id = b.case_id AND a.k < b.k AND a.ell > 0 AND b.ell > 0 AND a.stage = 'S2_CONTROL_TAKEOVER' AND b.stage = 'S5_POSITIONING' AND b.us - a.us <= 86400000000),
cloud AS (SELECT b.case_id, min(b.k) AS k FROM w b JOIN w a ON a.case_id = b.case_id AND a.k < b.k AND a.ip = b.ip AND a.ell > 0 AND b.ell > 0 AND b.detector = 'cyber' GROUP BY 1),
marks AS (SELECT case_id, k, bool_or(reason = 'CUSTOMER_DENIED') OVER upto AS denied, bool_or(detector = 'graph' AND reason = 'SEED_DISTANCE_0') OVER upto AS seed,
  coalesce(max(CASE WHEN detector = 'txn' AND p >= 0.9 THEN us END) OVER upto > coalesce(max(CASE WHEN reason = 'STEP_UP_PASSED_TRUSTED' THEN us END) OVER upto, -1), false) AS sure FROM w WINDOW upto AS (PARTITION BY case_id ORDER BY k)),
positioned AS (SELECT DISTINCT x.case_id, x.k FROM w x JOIN pairs p ON p.case_id = x.case_id AND p.k <= x.k WHERE NOT EXISTS (SELECT 1 FROM w d WHERE d.case_id = x.case_id AND d.k <= x.k AND d.reason = 'STEP_UP_PASSED_TRUSTED' AND d.us >= p.us)),
f AS (SELECT w.*, s.total, s.amount AS risk, coalesce(ato1.k <= w.k, false) AS ato1, coalesce(ato2.k <= w.k, false) AND NOT coalesce(ato1.k <= w.k, false) AS ato2, coalesce(app.k <= w.k, false) AND NOT coalesce(s2.k <= w.k, false) AS app,
  coalesce(three.k <= w.k, false) AS three, positioned.k IS NOT NULL AS pos, coalesce(cloud.k <= w.k, false) AS cloud, marks.denied, marks.seed, marks.sure FROM w JOIN marks ON marks.case_id = w.case_id AND marks.k = w.k LEFT JOIN cloud ON cloud.case_id = w.case_id JOIN s ON s.case_id = w.case_id AND s.upto = w.k LEFT JOIN ato1 ON ato1.case_id = w.case_id LEFT JOIN ato2 ON ato2.case_id = w.case_id LEFT JOIN app ON app.case_id = w.case_id
  LEFT JOIN s2 ON s2.case_id = w.case_id LEFT JOIN three ON three.case_id = w.case_id LEFT JOIN positioned ON positioned.case_id = w.case_id AND positioned.k = w.k),
g AS (SELECT *, ln(0.01::DOUBLE / 0.99) + total + CASE WHEN ato1 THEN 0.5 ELSE 0 END + CASE WHEN ato2 THEN 0.5 ELSE 0 END + CASE WHEN app THEN 1.0 ELSE 0 END + CASE WHEN cloud THEN 0.3 ELSE 0 END AS log_odds FROM f),
h AS (SELECT *, 1 / (1 + exp(-log_odds)) AS p_attack FROM g),
b AS (SELECT *, CASE WHEN p_attack >= 0.8 THEN 4 WHEN p_attack >= 0.5 THEN 3 WHEN p_attack >= 0.2 THEN 2 ELSE 1 END AS raw, greatest(raw, CASE WHEN denied THEN 4 WHEN pos OR seed OR sure THEN 3 ELSE 1 END, CASE WHEN three THEN 2 ELSE 1 END) AS lvl FROM h),
t AS (SELECT *, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][lvl] AS band FROM b)"""

DECIDED = PREFIX + """,
rule AS (SELECT *, CASE WHEN band = 'CRITICAL' THEN 'critical' WHEN pos THEN 'ato_new_payee_hold' WHEN sure THEN 'txn_high_confidence_hold' WHEN reason = 'APP_SCAM_COOLING_OFF' THEN 'app_scam_cooling_off' WHEN band = 'HIGH' THEN 'high' WHEN app THEN 'app_scam_hold'
  WHEN reason = 'INSIDER_CHANGE_AFTER_NEW_DEVICE_LOGIN' THEN 'insider_staff_change' WHEN band = 'MEDIUM' AND reason = 'APP_SCAM_WARNING' THEN 'app_scam_warning_medium'
  WHEN band = 'MEDIUM' THEN 'medium' WHEN reason = 'APP_SCAM_WARNING' THEN 'app_scam_warning' WHEN reason = 'CREDENTIAL_STUFFING_IP' THEN 'credential_stuffing' WHEN reason = 'ACCOUNT_DISTRIBUTED_FAILURES' THEN 'distributed_stuffing' WHEN reason = 'SESSION_CONTEXT_CHANGE' THEN 'session_context_change' ELSE 'low' END AS rule0 FROM t),
own AS (SELECT *, CASE WHEN rule0 = 'critical' THEN 2 WHEN rule0 IN ('ato_new_payee_hold', 'txn_high_confidence_hold', 'app_scam_cooling_off', 'high', 'app_scam_hold', 'insider_staff_change') THEN 1 ELSE 0 END AS own FROM rule),
cand AS (SELECT a.*, a.detector IN ('auth', 'cyber') AND a.ell > 0 AND a.reason NOT IN ('STEP_UP_PASSED_TRUSTED', 'CUSTOMER_DENIED') AND a.lvl >= 3 AND a.own < 2 AND coalesce((SELECT max(x.own) FROM own x WHERE x.case_id = a.case_id AND x.k < a.k), 0) = 1 AS c FROM own a),
late AS (SELECT *, c AND k = (SELECT min(k) FROM cand y WHERE y.case_id = cand.case_id AND y.c) AS late FROM cand),
dec AS (SELECT *, CASE WHEN late THEN 'late_evidence_block' ELSE rule0 END AS rule, CASE WHEN late THEN 2 ELSE own END AS st, CASE WHEN late THEN 3 ELSE CASE WHEN own = 2 THEN 3 WHEN own = 1 THEN 2 WHEN rule0 = 'low' THEN 0 ELSE 1 END END AS severity FROM late)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.timeline(evidence(spark, sf_dir))


def joined(c: str):
    return F.array_join(c, ",")


@query("r1_fused_timeline", PREFIX + """ SELECT case_id, evidence_id, round(log_odds, 6) AS log_odds, round(p_attack, 6) AS p_attack, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][raw] AS band_before_floors, band, CAST(risk AS BIGINT) AS amount_at_risk,
  array_to_string(list_filter([CASE WHEN ato1 THEN 'pat_ATO1' END, CASE WHEN cloud THEN 'pat_CASE_IP_CLOUD' END, CASE WHEN app THEN 'pat_APP_SCAM1' END, CASE WHEN ato2 THEN 'pat_ATO2' END], lambda x: x IS NOT NULL), ',') AS patterns,
  array_to_string(list_filter([CASE WHEN denied THEN 'floor_CUSTOMER_DENIED' END, CASE WHEN seed THEN 'floor_SEED_PAYEE' END, CASE WHEN three THEN 'floor_THREE_STAGES' END, CASE WHEN pos THEN 'floor_S2_THEN_NEW_PAYEE' END, CASE WHEN sure THEN 'floor_TXN_HIGH_CONFIDENCE' END], lambda x: x IS NOT NULL), ',') AS floors FROM t""")
def _(spark, sf_dir):
    return points(spark, sf_dir).select("case_id", "evidence_id", "log_odds", "p_attack", "band_before_floors", "band", "amount_at_risk", joined("patterns").alias("patterns"), joined("floors").alias("floors"))


@query("f11_fused_cases", PREFIX + " SELECT case_id, round(log_odds, 6) AS log_odds, round(p_attack, 6) AS p_attack, band, CAST(risk AS BIGINT) AS amount_at_risk FROM t WHERE k = (SELECT max(k) FROM w x WHERE x.case_id = t.case_id)")
def _(spark, sf_dir):
    return fusion.fused(points(spark, sf_dir)).select("case_id", "log_odds", "p_attack", "band", "amount_at_risk")


CONTRIBUTED = EVIDENCE + ", c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY case_id, family ORDER BY ell DESC, us, evidence_id) = 1 THEN ell ELSE ell / 2 END AS contribution FROM w)"


@query("f1_f2_contributions", CONTRIBUTED + " SELECT case_id, evidence_id, family, round(ell, 6) AS weight, round(contribution, 6) AS contribution FROM c")
def _(spark, sf_dir):
    return fusion.contributions(evidence(spark, sf_dir)).select("case_id", "evidence_id", "family", "weight", "contribution")


@query("f9_stage_hits", CONTRIBUTED + " SELECT case_id, stage, us, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, stage ORDER BY us, evidence_id) AS n FROM c WHERE contribution > 0) WHERE n = 1")
def _(spark, sf_dir):
    return fusion.stage_hits(fusion.contributions(evidence(spark, sf_dir)))


@query("x1_waterfall", CONTRIBUTED + " SELECT a.case_id, a.evidence_id, any_value(a.detector) AS detector, round(any_value(a.contribution), 6) AS contribution, round(ln(0.01::DOUBLE / 0.99) + sum(b.contribution), 6) AS log_odds_after FROM c a JOIN c b ON a.case_id = b.case_id AND b.k <= a.k GROUP BY 1, 2")
def _(spark, sf_dir):
    return fusion.waterfall(fusion.contributions(evidence(spark, sf_dir)))


@query("p1_p4_decisions", DECIDED + """, o AS (SELECT *, CASE WHEN rule0 IN ('ato_new_payee_hold', 'txn_high_confidence_hold', 'high', 'app_scam_hold') THEN 'STEP_UP_TRUSTED_FACTOR' WHEN rule0 IN ('medium', 'app_scam_warning_medium', 'session_context_change') THEN 'STEP_UP_ANY_FACTOR' ELSE '' END AS su FROM dec)
SELECT case_id, evidence_id, rule, CAST(severity AS INTEGER) AS severity, ['normal', 'held', 'blocked'][CAST(max(st) OVER (PARTITION BY case_id ORDER BY k) AS INTEGER) + 1] AS payment_state,
  CASE WHEN su <> '' AND su IS DISTINCT FROM lag(su) OVER (PARTITION BY case_id ORDER BY k) THEN su ELSE '' END AS step_up FROM o""")
def _(spark, sf_dir):
    return policy.decisions(points(spark, sf_dir)).select("case_id", "evidence_id", "rule", "severity", "payment_state", joined("step_up").alias("step_up"))


@query("r2_siloed_timeline", EVIDENCE + " SELECT case_id, evidence_id, CASE WHEN p >= 0.03 THEN 'SILOED_ALERT' ELSE 'SILOED_NONE' END AS band, CASE WHEN p >= 0.03 AND detector = 'txn' THEN 'BLOCK_PENDING_PAYMENTS' ELSE 'ALLOW' END AS action FROM w")
def _(spark, sf_dir):
    return fusion.siloed(evidence(spark, sf_dir), 0.03).drop("us")


REPLAY = """, e AS (SELECT case_id, arg_min(evidence_id, k) AS eip, min(us) AS eip_us FROM dec WHERE severity >= 2 GROUP BY 1),
pay AS (SELECT case_id, min(us) AS us FROM dec WHERE stage = 'S6_MONETIZATION' GROUP BY 1),
m AS (SELECT d.case_id, sum(d.amount) AS m FROM dec d JOIN e ON e.case_id = d.case_id AND d.us >= e.eip_us WHERE d.stage = 'S6_MONETIZATION' GROUP BY 1)
SELECT c.case_id, e.eip, e.eip_us, CAST(floor((pay.us - e.eip_us) / 1000000.0) AS BIGINT) AS lead_s, CAST(coalesce(m.m, 0) AS BIGINT) AS money_protected FROM (SELECT DISTINCT case_id FROM w) c LEFT JOIN e USING (case_id) LEFT JOIN pay USING (case_id) LEFT JOIN m USING (case_id)"""


@query("r3_replay", DECIDED + REPLAY)
def _(spark, sf_dir):
    return policy.replay(policy.decisions(points(spark, sf_dir)))


@query("r3_replay_without_auth", DECIDED.replace(" FROM d WHERE true)", " FROM d WHERE detector <> 'auth')", 1) + REPLAY)
def _(spark, sf_dir):
    return policy.replay(policy.decisions(fusion.timeline(evidence(spark, sf_dir).where("detector <> 'auth'"))))


@query("a5_alert_compression", PREFIX + """, l AS (SELECT * FROM t WHERE k = (SELECT max(k) FROM w x WHERE x.case_id = t.case_id)), n AS (SELECT case_id, count(*) AS alerts FROM w WHERE p >= 0.03 GROUP BY 1)
SELECT l.band, count(*) AS cases, CAST(sum(coalesce(n.alerts, 0)) AS BIGINT) AS alerts, round(sum(coalesce(n.alerts, 0)) / count(n.alerts), 6) AS compression FROM l LEFT JOIN n USING (case_id) GROUP BY 1""")
def _(spark, sf_dir):
    found = evidence(spark, sf_dir)
    alerts = found.where("p >= 0.03").groupBy("case_id").agg(F.count("*").alias("alerts"))
    cases = fusion.fused(fusion.timeline(found)).select("case_id", "band").join(alerts, "case_id", "left")
    return cases.groupBy("band").agg(F.count("*").alias("cases"), F.sum(F.coalesce("alerts", F.lit(0))).alias("alerts"), (F.sum(F.coalesce("alerts", F.lit(0))) / F.count("alerts")).alias("compression"))


@query("a9_stage_transitions", EVIDENCE + """, o AS (SELECT case_id, stage, us, lag(stage) OVER x AS prev, lag(us) OVER x AS before FROM w WINDOW x AS (PARTITION BY case_id ORDER BY us, evidence_id))
SELECT prev AS from_stage, stage AS to_stage, count(*) AS count, round(median((us - before) / 60000000.0), 6) AS median_minutes FROM o WHERE prev <> stage GROUP BY 1, 2""")
def _(spark, sf_dir):
    over = Window.partitionBy("case_id").orderBy("us", "evidence_id")
    rows = evidence(spark, sf_dir).select("stage", F.lag("stage").over(over).alias("from_stage"), ((F.col("us") - F.lag("us").over(over)) / 60_000_000).alias("gap"))
    return rows.where("from_stage <> stage").groupBy("from_stage", F.col("stage").alias("to_stage")).agg(F.count("*").alias("count"), F.percentile("gap", F.lit(0.5)).alias("median_minutes"))


@query("s1_case_queue", PREFIX + " SELECT case_id, band, round(p_attack, 6) AS p_attack, us FROM t WHERE k = (SELECT max(k) FROM w x WHERE x.case_id = t.case_id) ORDER BY lvl DESC, round(log_odds, 9) DESC, us DESC, case_id LIMIT 50")
def _(spark, sf_dir):
    cases = fusion.fused(points(spark, sf_dir))
    return cases.orderBy(fusion.band_rank(F.col("band")).desc(), F.round("log_odds", 9).desc(), F.desc("us"), "case_id").limit(50).select("case_id", "band", "p_attack", "us")


SLICE = f"""WITH {EVENTS_SQL}, tx AS (SELECT * FROM ev WHERE kind = 'transaction'),
n AS (SELECT a.event_id, a.customer, a.us, a.amount, count(*) FILTER (WHERE (b.amount >= 9500000 AND b.amount < 10000000) OR (b.amount >= 19000000 AND b.amount < 20000000) OR (b.amount >= 47500000 AND b.amount < 50000000)) AS near
  FROM tx a JOIN tx b ON b.customer = a.customer AND (b.us, b.event_id) <= (a.us, a.event_id) AND b.us >= a.us - 30 * 86400000000 GROUP BY 1, 2, 3, 4),
e AS (SELECT *, 0.85::DOUBLE * greatest(-2.0, least(3.0, ln(p / (1 - p)) - ln(0.01::DOUBLE / 0.99))) AS ell FROM (SELECT *, CASE WHEN near >= 2 THEN 0.12::DOUBLE ELSE 0.005::DOUBLE END AS p FROM n)),
r AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY ell DESC, us, event_id) AS rank FROM e),
s AS (SELECT customer, ln(0.01::DOUBLE / 0.99) + sum(CASE WHEN rank = 1 THEN ell ELSE ell / 2 END) AS lo, count(*) FILTER (WHERE near >= 2) AS structuring FROM r WHERE near >= 2 GROUP BY 1)
SELECT customer, structuring, round(1 / (1 + exp(-lo)), 6) AS p_attack, CASE WHEN 1 / (1 + exp(-lo)) >= 0.8 THEN 'CRITICAL' WHEN 1 / (1 + exp(-lo)) >= 0.5 THEN 'HIGH' WHEN 1 / (1 + exp(-lo)) >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM s"""


@query("slice1_fused_risk", SLICE)
def _(spark, sf_dir):
    """Near-limit transfers of 30 days as structuring evidence, fused to a probability per customer."""
    near = features.near_limit(F.col("amount"), features.LIMITS).isNotNull()
    sent = ordered(events(spark, sf_dir).where("kind = 'transaction'"))
    hits = sent.withColumn("near", features.count_if(near, features.window(["customer"], 30 * features.DAY, 0))).where("near >= 2")
    items = hits.select(F.col("event_id").alias("evidence_id"), F.col("customer").alias("case_id"), "us", F.lit("transaction").alias("family"), F.lit(0.12).alias("p"), F.lit(0.85).alias("reliability"))
    fused = fusion.contributions(items).groupBy(F.col("case_id").alias("customer")).agg(F.count("*").alias("structuring"), F.sum("contribution").alias("total"))
    p = fusion.sigmoid(fusion.logit(F.lit(0.01)) + F.col("total"))
    return fused.select("customer", "structuring", p.alias("p_attack"), fusion.band(p).alias("band"))


#: Groups of reasons that tell one fact, for the evidence above.
GROUPS = (correlation.Group("corr_ACCESS", ("SESSION_CONTEXT_CHANGE", "CREDENTIAL_STUFFING_IP", "RULE")), correlation.Group("corr_PAYEE", ("PAYEE_NAME_MISMATCH", "APP_SCAM_WARNING", "SEED_DISTANCE_0"), 0.25))


@query("f4_correlation_discounts")
def _(spark, sf_dir):
    """Items that tell what a stronger one of another family told within six hours, and the contribution that is left."""
    items = fusion.contributions(evidence(spark, sf_dir)).withColumn("customers", F.array("customer"))
    found = correlation.discounts(items, GROUPS, 6 * features.HOUR)
    left = correlation.discounted(items, found).select("case_id", "evidence_id", "contribution")
    return found.join(left, ["case_id", "evidence_id"])


#: A pattern beyond the file's: given as its object, without code of its own.
MORE_PATTERNS = patterns.extended(patterns.PATTERNS, [
    {"id": "pat_PROBED_LOGIN", "sequence": ["S0_RECON", "S1_INITIAL_ACCESS", "S6_MONETIZATION"], "first_reason_any": ["CREDENTIAL_STUFFING_IP", "ACCOUNT_DISTRIBUTED_FAILURES"], "within_min": 2880, "total_within_min": 4320, "absent_stages": ["S2_CONTROL_TAKEOVER"], "unless_patterns": ["pat_APP_SCAM1"], "bonus": 0.25},
])


@query("f5_pattern_hits", PREFIX + """,
probed AS (SELECT c.case_id, min(c.k) AS k FROM w a JOIN w b ON a.case_id = b.case_id AND a.k < b.k AND b.us - a.us <= 172800000000 JOIN w c ON c.case_id = b.case_id AND b.k < c.k AND c.us - b.us <= 172800000000 AND c.us - a.us <= 259200000000
  WHERE a.ell > 0 AND b.ell > 0 AND c.ell > 0 AND a.stage = 'S0_RECON' AND a.reason IN ('CREDENTIAL_STUFFING_IP', 'ACCOUNT_DISTRIBUTED_FAILURES') AND b.stage = 'S1_INITIAL_ACCESS' AND c.stage = 'S6_MONETIZATION' GROUP BY 1),
calm AS (SELECT * FROM app WHERE case_id NOT IN (SELECT case_id FROM s2)),
hits AS (SELECT *, 'pat_ATO1' AS pattern, 0.5::DOUBLE AS bonus FROM ato1 UNION ALL SELECT *, 'pat_CASE_IP_CLOUD', 0.3 FROM cloud UNION ALL SELECT *, 'pat_APP_SCAM1', 1.0 FROM calm UNION ALL SELECT *, 'pat_ATO2', 0.5 FROM ato2 WHERE case_id NOT IN (SELECT case_id FROM ato1)
  UNION ALL SELECT *, 'pat_PROBED_LOGIN', 0.25 FROM probed WHERE case_id NOT IN (SELECT case_id FROM s2) AND case_id NOT IN (SELECT case_id FROM calm))
SELECT case_id, pattern, bonus, evidence_id AS completed_by FROM hits JOIN w USING (case_id, k)""")
def _(spark, sf_dir):
    """Patterns that hold at the end of each case, and the item that completed each: the file's four and one more."""
    items = evidence(spark, sf_dir).repartition("case_id").withColumn("live", fusion.weight(F.col("p"), F.col("reliability")) > 0)
    last = fusion.fused(patterns.with_hits(items, MORE_PATTERNS).select("case_id", "us", "evidence_id", "hits"))
    return last.select("case_id", F.explode("hits").alias("hit")).select("case_id", "hit.pattern", "hit.bonus", F.col("hit.evidence_id").alias("completed_by"))
