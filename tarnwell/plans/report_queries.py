"""Report, join and remaining detector queries over the bridged events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import detectors, enrich, features, fusion, graph, reports
from ..sources.bridge import EVENTS_SQL, events, ordered
from .detector_queries import RULES, shown
from .fusion_queries import CONTRIBUTED, EVIDENCE, PREFIX, evidence, points
from .graph_queries import NOW, OBS, edge_table
from .registry import SQL, query

EV = f"WITH {EVENTS_SQL} "


def pick(i, *values):
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


@query("pf2_event_tokens", EV + "SELECT event_id, array_to_string(list_sort(list_distinct(list_filter([customer, account, device, ip, payee], lambda x: x IS NOT NULL))), ',') AS tokens FROM ev")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.array_join(reports.tokens("customer", "account", "device", "ip", "payee"), ",").alias("tokens"))


@query("pf4_platform", EV + "SELECT event_id, 'ua:' || ['android', 'ios', 'windows', 'macos', 'linux', 'other'][CAST(k % 6 AS INTEGER) + 1] AS platform FROM ev")
def _(spark, sf_dir):
    agent = pick(F.col("k") % 6, "Mozilla (Linux; Android 14)", "Mozilla (iPhone)", "Windows NT 10.0", "Intel Mac OS X", "X11; Linux", "probe/1")
    return events(spark, sf_dir).select("event_id", enrich.platform(agent).alias("platform"))


@query("pf9_device_mask", EV + """, x AS (SELECT *, k % 3 <> 1 AS mobile, k % 2 = 0 AS mouse, k % 4 AS g FROM ev)
SELECT event_id, CAST(CASE WHEN mobile AND mouse THEN 1 ELSE 0 END + CASE WHEN NOT mobile AND g IN (0, 3) THEN 2 ELSE 0 END + CASE WHEN mobile AND g = 1 THEN 4 ELSE 0 END + CASE WHEN g = 2 THEN 8 ELSE 0 END
  + CASE WHEN mobile AND k % 5 = 0 THEN 16 ELSE 0 END + CASE WHEN k % 3 <> 0 THEN 32 ELSE 0 END AS INTEGER) AS mask FROM x""")
def _(spark, sf_dir):
    k = F.col("k")
    mask = enrich.device_mask(pick(k % 3, "Android", "Windows", "iOS"), pick(k % 2, "mouse", "touch"), pick(k % 4, "Adreno 640", "NVIDIA RTX", "SwiftShader", "Apple GPU"), F.when(k % 5 == 0, 1800).otherwise(1000), F.lit("Android"))
    return events(spark, sf_dir).select("event_id", mask.alias("mask"))


@query("pf10_near_limit", EV + "SELECT event_id, CAST(CASE WHEN amount >= 9500000 AND amount < 10000000 THEN 10000000 WHEN amount >= 19000000 AND amount < 20000000 THEN 20000000 WHEN amount >= 47500000 AND amount < 50000000 THEN 50000000 END AS BIGINT) AS near_limit FROM ev WHERE kind = 'transaction'")
def _(spark, sf_dir):
    return events(spark, sf_dir).where("kind = 'transaction'").select("event_id", scalars.near_limit(F.col("amount"), features.LIMITS).alias("near_limit"))


@query("pf12_token_filter", EV + "SELECT event_id, us FROM ev WHERE ip = 'ip:3'")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(F.array_contains(reports.tokens("customer", "device", "ip"), "ip:3")).select("event_id", "us")


@query("j1_labelled_evidence", EVIDENCE + ", l AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 'FRAUD' ELSE 'LEGIT' END AS label FROM ev) SELECT DISTINCT case_id, detector, label FROM item JOIN l ON l.event_id = item.evidence_id")
def _(spark, sf_dir):
    labels = events(spark, sf_dir).select(F.col("event_id").alias("evidence_id"), F.when(F.col("k") % 10 == 0, "FRAUD").otherwise("LEGIT").alias("label"))
    return evidence(spark, sf_dir).join(labels, "evidence_id").select("case_id", "detector", "label").distinct()


@query("j4_v3_payment_rail", EV + """, o AS (SELECT event_id, ['completed', 'held', 'blocked'][CAST(k % 4 AS INTEGER) + 1] AS outcome FROM ev WHERE kind = 'transaction' AND k % 3 = 0)
SELECT t.event_id, t.amount, coalesce(CASE o.outcome WHEN 'completed' THEN 'CAPTURED' WHEN 'held' THEN 'AUTHORIZED' WHEN 'blocked' THEN 'VOIDED' END, 'CREATED') AS rail FROM ev t LEFT JOIN o USING (event_id) WHERE kind = 'transaction'""")
def _(spark, sf_dir):
    sent = events(spark, sf_dir).where("kind = 'transaction'")
    outcomes = sent.where("k % 3 = 0").select("event_id", pick(F.col("k") % 4, "completed", "held", "blocked").alias("outcome"))
    return sent.join(outcomes, "event_id", "left").select("event_id", "amount", reports.rail_state(F.col("outcome")).alias("rail"))


@query("j5_snk5_baseline_diff", EV + f""", o AS (SELECT customer, count(*) AS n, max(us) AS last FROM ev WHERE us < {NOW} GROUP BY 1), n AS (SELECT customer, count(*) AS n, max(us) AS last FROM ev GROUP BY 1)
SELECT n.customer, n.n, n.last, CASE WHEN o.customer IS NULL THEN 'new' ELSE 'changed' END AS status FROM n LEFT JOIN o USING (customer) WHERE o.customer IS NULL OR n.n <> o.n OR n.last <> o.last""")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    state = lambda rows: rows.groupBy("customer").agg(F.count("*").alias("n"), F.max("us").alias("last"))
    return reports.changed(state(e.where(F.col("us") < NOW)), state(e), "customer", "n", "last")


@query("j13_state_before_payment", EV + "SELECT a.event_id, arg_max(b.result, (b.us, b.event_id)) AS state FROM ev a LEFT JOIN ev b ON b.kind = 'login' AND b.customer = a.customer AND (b.us, b.event_id) < (a.us, a.event_id) WHERE a.kind = 'transaction' GROUP BY 1")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    return reports.state_before(e.where("kind = 'transaction'"), e.where("kind = 'login'").withColumnRenamed("result", "state"), "customer")


@query("a1_a8_overview", PREFIX + " SELECT band, count(*) AS cases, count(*) FILTER (WHERE p_attack >= 0.5) AS likely, CAST(sum(risk) AS BIGINT) AS amount_at_risk FROM t WHERE k = (SELECT max(k) FROM w x WHERE x.case_id = t.case_id) GROUP BY 1")
def _(spark, sf_dir):
    cases = fusion.fused(points(spark, sf_dir))
    return cases.groupBy("band").agg(F.count("*").alias("cases"), F.count_if(F.col("p_attack") >= 0.5).alias("likely"), F.sum("amount_at_risk").alias("amount_at_risk"))


@query("a6_detection_quality", EVIDENCE + """, x AS (SELECT family, count(*) FILTER (WHERE p >= 0.03 AND value > 20) AS tp, count(*) FILTER (WHERE p >= 0.03 AND NOT value > 20) AS fp, count(*) FILTER (WHERE NOT p >= 0.03 AND value > 20) AS fn FROM item JOIN ev ON ev.event_id = item.evidence_id GROUP BY 1)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM x""")
def _(spark, sf_dir):
    real = events(spark, sf_dir).select(F.col("event_id").alias("evidence_id"), (F.col("value") > 20).alias("real"))
    rows = evidence(spark, sf_dir).join(real, "evidence_id").withColumn("found", F.col("p") >= 0.03)
    return reports.detection(rows, "family", "found", "real")


@query("a11_nearest_rank", EV + """, r AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY value) AS i, count(*) OVER (PARTITION BY kind) AS n FROM ev)
SELECT kind, any_value(n) AS n, round(max(value) FILTER (WHERE i = ceil(0.5 * n)), 6) AS p50, round(max(value) FILTER (WHERE i = ceil(0.95 * n)), 6) AS p95, round(max(value) FILTER (WHERE i = ceil(0.99 * n)), 6) AS p99 FROM r GROUP BY 1""")
def _(spark, sf_dir):
    return reports.nearest_rank(events(spark, sf_dir), "kind", "value")


@query("a14_repeated_denials", EV + ", f AS (SELECT * FROM ev WHERE result = 'failure') SELECT a.event_id, count(*) AS n, count(*) >= 2 AS flagged FROM f a JOIN f b ON b.customer = a.customer AND (b.us, b.event_id) <= (a.us, a.event_id) AND b.us >= a.us - 24 * 3600000000 GROUP BY 1")
def _(spark, sf_dir):
    return reports.repeated(ordered(events(spark, sf_dir)).where("result = 'failure'"), "customer", 24 * scalars.HOUR, 2)


@query("a15_scaled_to_median", EV + ", m AS (SELECT asn, median(value) AS m FROM ev GROUP BY 1) SELECT event_id, round(CASE WHEN m > 0 THEN value * 150000.0::DOUBLE / m ELSE 0.0 END, 6) AS scaled FROM ev JOIN m USING (asn)")
def _(spark, sf_dir):
    return reports.scaled_to_median(events(spark, sf_dir), "asn", "value")


@query("g13_device_rings", f"WITH pr AS ({SQL['g10_g14_flow_profile']}), lg AS ({OBS} SELECT DISTINCT src AS account, dst AS device FROM edges WHERE edge_type = 'LOGGED_IN_FROM' AND dst NOT IN (SELECT token FROM hub)) SELECT device, count(*) AS accounts, CAST(coalesce(sum(new_payers_window), 0) AS BIGINT) AS new_payers FROM lg LEFT JOIN pr USING (account) GROUP BY 1 HAVING count(*) >= 2 AND coalesce(sum(new_payers_window), 0) >= 4")
def _(spark, sf_dir):
    edges = edge_table(spark, sf_dir)
    return reports.device_rings(edges, graph.flow_profile(edges, NOW), graph.excluded(edges))


@query("d1_ids_alerts", EV + ", hits AS (SELECT event_id, 'IDS_SEV' || (k % 3 + 1) AS code, CASE k % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.03 ELSE 0.015 END AS p FROM ev WHERE kind = 'login') " + RULES.format(detector="netsec", family="cyber", stage="S0_RECON", trust="0.5", more=""))
def _(spark, sf_dir):
    return shown(detectors.ids_alerts(events(spark, sf_dir).where("kind = 'login'").withColumn("severity", F.col("k") % 3 + 1)))


@query("d7_identity_checks", EV + """, hits AS (SELECT event_id, 'LOW_LIVENESS' AS code, 0.06::DOUBLE AS p FROM ev WHERE (k % 10) / 10.0 < 0.5 UNION ALL SELECT event_id, 'LOW_FACE_MATCH', 0.05 FROM ev WHERE (k % 7) / 7.0 < 0.7 UNION ALL SELECT event_id, 'DOC_TAMPER', 0.06 FROM ev WHERE k % 4 = 3
  UNION ALL SELECT event_id, 'INJECTION_SUSPECTED', 0.12 FROM ev WHERE k % 9 = 0) """ + RULES.format(detector="kyc", family="kyc", stage="S3_IDENTITY_MANIPULATION", trust="0.6", more=""))
def _(spark, sf_dir):
    k = F.col("k")
    return shown(detectors.identity_checks(events(spark, sf_dir).withColumns({"liveness_score": (k % 10) / 10, "face_match_score": (k % 7) / 7, "doc_tamper_score": (k % 4) / 4, "injection_suspected": k % 9 == 0})))


@query("d8_cloud_audit", EV + """SELECT event_id, 'cyber' AS detector, 'cyber' AS family, ['S4_ESCALATION', 'S0_RECON', 'S2_CONTROL_TAKEOVER'][CAST(k % 3 AS INTEGER) + 1] AS stage, [0.04, 0.03, 0.05][CAST(k % 3 AS INTEGER) + 1]::DOUBLE AS p, 0.5::DOUBLE AS reliability,
  ['cloud_limit_raise_untrusted_ip', 'bulk_profile_read_support_console', 'mfa_reset_by_support_untrusted_ip'][CAST(k % 3 AS INTEGER) + 1] AS reasons FROM ev WHERE CASE k % 3 WHEN 1 THEN k >= 20 ELSE k % 2 = 1 END""")
def _(spark, sf_dir):
    k = F.col("k")
    rows = events(spark, sf_dir).withColumns({"action": pick(k % 3, "UpdateTransferLimit", "ReadCustomerProfile", "ResetCustomerMfa"), "src_ip_trusted": k % 2 == 0, "actor_type": F.lit("support_console"), "reads_10m": k})
    return shown(detectors.cloud_audit(rows))


@query("l1_feedback_credit", CONTRIBUTED + " SELECT detector, count(*) FILTER (WHERE contribution > 0.5) AS credited, count(*) AS items FROM c GROUP BY 1")
def _(spark, sf_dir):
    return reports.credited(fusion.contributions(evidence(spark, sf_dir)))


@query("s5_top_contributions", CONTRIBUTED + " SELECT case_id, evidence_id, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(contribution, 9) DESC, us, evidence_id) AS n FROM c) WHERE n <= 3")
def _(spark, sf_dir):
    place = F.row_number().over(features.Window.partitionBy("case_id").orderBy(F.round("contribution", 9).desc(), "us", "evidence_id"))
    return fusion.contributions(evidence(spark, sf_dir)).withColumn("place", place).where("place <= 3").select("case_id", "evidence_id", "place")


@query("m3_time_split", EV + """, f AS (SELECT *, (us - (SELECT min(us) FROM ev)) // 86400000000 + 1 AS day FROM ev) SELECT CASE WHEN day <= 9 THEN 'train' WHEN day <= 11 THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(us) AS first, max(us) AS last FROM f GROUP BY 1""")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.agg(F.min("us").alias("first")).first()["first"]
    return e.groupBy(reports.time_split(F.col("us"), F.lit(first)).alias("part")).agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))


@query("st5_tumbling_failures", EV + "SELECT (us // 3600000000) * 3600000000 AS start, count(*) AS n, count(DISTINCT account) AS accounts FROM ev WHERE result = 'failure' AND kind = 'login' GROUP BY 1")
def _(spark, sf_dir):
    failed = events(spark, sf_dir).where("kind = 'login' and result = 'failure'")
    hours = failed.groupBy(F.window(F.timestamp_micros("us"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("account").alias("accounts"))
    return hours.select(F.unix_micros("w.start").alias("start"), "n", "accounts")


@query("v2_limit_requests", EV + "SELECT k % 25 AS request, count(*) AS steps, ['REQUESTED', 'APPROVED', 'REJECTED', 'EXPIRED'][CAST(arg_max(event_id, (us, event_id)) % 4 AS INTEGER) + 1] AS status FROM ev GROUP BY 1")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("k") % 25).alias("request"), "us", "event_id", pick(F.col("event_id") % 4, "REQUESTED", "APPROVED", "REJECTED", "EXPIRED").alias("status"))
    return rows.groupBy("request").agg(F.count("*").alias("steps"), F.max_by("status", F.struct("us", "event_id")).alias("status"))


@query("x2_rupee_amounts", EV + r""", r AS (SELECT event_id, CAST(amount // 100 AS VARCHAR) AS r FROM ev WHERE kind = 'transaction')
SELECT event_id, CASE WHEN length(r) <= 3 THEN r ELSE ltrim(reverse(regexp_replace(reverse(r[:-4]), '(\d\d)', '\1,', 'g')), ',') || ',' || r[-3:] END AS rupees FROM r""")
def _(spark, sf_dir):
    return events(spark, sf_dir).where("kind = 'transaction'").select("event_id", reports.rupees(F.col("amount")).alias("rupees"))
