"""Upsert, outcome, summary, feedback, narrative and model queries over the bridged events and sample evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, attributions, features, fusion, models
from ..sources.bridge import EVENTS_SQL, events, ordered, table, typed
from ..sources.stable import stable
from .fusion_queries import CONTRIBUTED, EVIDENCE, PREFIX, evidence, points
from .graph_queries import FLOW, NOW, OBS, edge_table
from .graph_queries import graph as graph_operators
from .registry import query

EV = f"WITH {EVENTS_SQL} "
STATUS = "['OPEN', 'INVESTIGATING', 'FALSE_POSITIVE', 'CONFIRMED_FRAUD'][CAST(substr({0}, 6) AS BIGINT) % 4 + 1]"


def status(case: str):
    names = F.array(*[F.lit(x) for x in ("OPEN", "INVESTIGATING", "FALSE_POSITIVE", "CONFIRMED_FRAUD")])
    return F.get(names, (F.substring(case, 6, 20).cast("long") % 4).cast("int"))


@query("src9_scan_since", EV + f"SELECT event_id, us, kind FROM ev WHERE us >= {NOW}")
def _(spark, sf_dir):
    """The filter is on the table's own column, so it reaches the scan; bursts move events back, never forward."""
    recent = table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return typed(recent).where(F.col("us") >= NOW).select("event_id", "us", "kind")


@query("src15_payments_as_events", EV + """, t AS (SELECT *, row_number() OVER (PARTITION BY customer, payee ORDER BY us, event_id) AS n FROM ev WHERE kind = 'transaction')
SELECT 'transaction' AS kind, us, customer, payee, amount, k % 50 = 0 AS fraud FROM t UNION ALL SELECT 'payee_added', us - 1000000, customer, payee, NULL, NULL FROM t WHERE n = 1 UNION ALL SELECT 'login', us - 2000000, customer, NULL, NULL, NULL FROM t""")
def _(spark, sf_dir):
    return analytics.from_payments(events(spark, sf_dir).where("kind = 'transaction'").withColumn("fraud", F.col("k") % 50 == 0), True)


@query("snk1_edge_upsert", OBS + """ SELECT src, dst, edge_type, CAST(max(confidence) AS DOUBLE) AS confidence, min(us) AS first_seen, max(us) AS last_seen, count(*) AS count, array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 50), ',') AS ids FROM obs GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    """Two batches, merged one after the other, give what one merge of all gives."""
    seen = graph_operators.observations(events(spark, sf_dir))
    old, new = (graph_operators.merged(seen.where(c)) for c in (F.col("us") < NOW, F.col("us") >= NOW))
    return analytics.upserted(old, new).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("snk2_latest_rows", EV + "SELECT customer, arg_max(kind, (us, event_id)) AS kind, max(us) AS us FROM ev GROUP BY 1")
def _(spark, sf_dir):
    return analytics.latest(events(spark, sf_dir).select("customer", "kind", "us", "event_id"), ["customer"], ["us", "event_id"]).drop("event_id")


@query("w29_account_features", OBS + FLOW.format(days=30) + f""", pp AS (SELECT dst AS account, src, max(last) AS last, min(first_seen) AS first, max(confidence * pow(0.5, (({NOW} - last) / 3600000000.0) / 72.0)) AS w FROM e WHERE edge_type IN ('SENT', 'ADDED_PAYEE') GROUP BY 1, 2),
i AS (SELECT account, count(*) AS payers, count(*) FILTER (WHERE last >= {NOW} - 86400000000) AS u, count(*) FILTER (WHERE first >= {NOW} - 86400000000) AS n, sum(w) AS w FROM pp GROUP BY 1),
o AS (SELECT src AS account, count(*) AS b, count(*) FILTER (WHERE first_seen >= {NOW} - 86400000000) AS nb FROM e WHERE edge_type = 'SENT' GROUP BY 1)
SELECT account, round(age, 6) AS account_age_days, coalesce(payers, 0) AS payers, coalesce(u, 0) AS unique_payers_24h, coalesce(n, 0) AS new_payers_24h, coalesce(b, 0) AS beneficiaries, coalesce(o.nb, 0) AS new_beneficiaries_24h,
  round(CASE WHEN coalesce(u, 0) > 0 THEN coalesce(o.nb, 0) / u ELSE 0.0 END, 6)::DOUBLE AS inflow_outflow_ratio, round(coalesce(gap, -1.0), 6)::DOUBLE AS pass_through_min, (CASE WHEN idle AND coalesce(fr.fresh, 0) >= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS dormant_activated, round(coalesce(w, 0.0), 6)::DOUBLE AS decayed_fan_in
FROM age LEFT JOIN i USING (account) LEFT JOIN o USING (account) LEFT JOIN pt USING (account) LEFT JOIN fr USING (account)""")
def _(spark, sf_dir):
    return analytics.account_features(edge_table(spark, sf_dir), NOW)


@query("p5_payment_outcomes", EVIDENCE + """, x AS (SELECT evidence_id AS event_id, case_id, evidence_id % 3 AS nth, CASE evidence_id % 5 WHEN 0 THEN 'held' WHEN 1 THEN 'blocked' ELSE 'completed' END AS outcome, evidence_id // 4 AS g FROM w)
SELECT g AS event_id, CASE WHEN count(*) FILTER (WHERE outcome <> 'completed') > 0 THEN arg_min(outcome, event_id) FILTER (WHERE outcome <> 'completed') ELSE 'completed' END AS outcome,
  CASE WHEN count(*) FILTER (WHERE outcome <> 'completed') > 0 THEN arg_min(case_id, event_id) FILTER (WHERE outcome <> 'completed') ELSE arg_max(case_id, event_id) END AS case_id FROM x GROUP BY 1""")
def _(spark, sf_dir):
    """Four items in a row stand for one payment that touches several cases."""
    i = F.col("evidence_id")
    state = F.when(i % 5 == 0, "held").when(i % 5 == 1, "blocked").otherwise("normal")
    return analytics.outcomes(evidence(spark, sf_dir).select(F.floor(i / 4).alias("event_id"), "case_id", i.alias("nth"), state.alias("payment_state")))


@query("a2_a3_live_figures", PREFIX + f""", l AS (SELECT case_id, band, {STATUS.format('case_id')} AS status FROM t WHERE k = (SELECT max(k) FROM w x WHERE x.case_id = t.case_id)),
o AS (SELECT count(*) AS n, count(*) FILTER (WHERE band = 'CRITICAL') AS c FROM l WHERE status IN ('OPEN', 'INVESTIGATING')), al AS (SELECT count(*) AS a FROM w WHERE p >= 0.05 AND case_id IN (SELECT case_id FROM l WHERE status IN ('OPEN', 'INVESTIGATING'))),
m AS (SELECT coalesce(sum(amount), 0) AS m FROM w JOIN l USING (case_id) WHERE detector = 'txn' AND evidence_id % 5 IN (0, 1) AND status <> 'FALSE_POSITIVE')
SELECT n AS cases_open, c AS critical_open, CASE WHEN n > 0 THEN round(a / n, 4) ELSE 0.0 END AS alert_compression, CAST(m AS BIGINT) AS money_protected FROM o, al, m""")
def _(spark, sf_dir):
    items = stable(evidence(spark, sf_dir))
    cases = fusion.fused(fusion.timeline(items)).select("case_id", "band", status("case_id").alias("status"))
    outcome = F.when(F.col("evidence_id") % 5 == 0, "held").when(F.col("evidence_id") % 5 == 1, "blocked").otherwise("completed")
    return analytics.live_figures(cases, items, items.where("detector = 'txn'").select("evidence_id", "case_id", "amount", outcome.alias("outcome")))


@query("pf13_case_summaries", EVIDENCE + """, s AS (SELECT case_id, list_sort(list_distinct(list(stage))) AS st FROM w GROUP BY 1) SELECT case_id, array_to_string(st, ',') AS stages_reached, st[-1] AS current_stage FROM s""")
def _(spark, sf_dir):
    cases = evidence(spark, sf_dir).groupBy("case_id").agg(F.collect_set("stage").alias("stages"))
    return analytics.summaries(cases).withColumn("stages_reached", F.array_join("stages_reached", ","))


@query("pf11_case_filter", PREFIX + f" SELECT case_id, band FROM t WHERE k = (SELECT max(k) FROM w x WHERE x.case_id = t.case_id) AND {STATUS.format('case_id')} = 'OPEN' AND band IN ('HIGH', 'CRITICAL')")
def _(spark, sf_dir):
    cases = fusion.fused(points(spark, sf_dir)).withColumn("status", status("case_id"))
    return analytics.queue(cases, ["OPEN"], ["HIGH", "CRITICAL"]).select("case_id", "band")


@query("s3_hottest_cases", PREFIX + " SELECT case_id, round(p_attack, 6) AS p_attack FROM t WHERE k = (SELECT max(k) FROM w x WHERE x.case_id = t.case_id) ORDER BY round(log_odds, 9) DESC, case_id LIMIT 8")
def _(spark, sf_dir):
    return fusion.fused(points(spark, sf_dir)).orderBy(F.round("log_odds", 9).desc(), "case_id").limit(8).select("case_id", "p_attack")


@query("s7_g18_subgraph", OBS + f""", both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), w AS (SELECT 'acct:11' AS token, 0 AS hops UNION SELECT s.dst, w.hops + 1 FROM w JOIN both_ways s ON s.src = w.token WHERE w.hops < 2 AND w.token NOT IN (SELECT token FROM hub)),
near AS (SELECT token, min(hops) AS hops FROM w GROUP BY 1), top AS (SELECT token FROM near ORDER BY hops, token LIMIT 40)
SELECT 'acct:11' AS start, src, dst, edge_type FROM edges WHERE src IN (SELECT token FROM top) AND dst IN (SELECT token FROM top)""")
def _(spark, sf_dir):
    edges = edge_table(spark, sf_dir)
    start = spark.range(1).select(F.lit("acct:11").alias("start"))
    return analytics.subgraph(edges, start, 2, graph_operators.excluded(edges), 40)


@query("l1_feedback_steps", CONTRIBUTED + f""", v AS (SELECT DISTINCT case_id, {STATUS.format('case_id')} AS verdict FROM w) SELECT DISTINCT c.case_id, detector, (CASE verdict WHEN 'CONFIRMED_FRAUD' THEN 1.0 ELSE 0.0 END)::DOUBLE AS d_alpha, (CASE verdict WHEN 'FALSE_POSITIVE' THEN 1.0 ELSE 0.0 END)::DOUBLE AS d_beta
FROM c JOIN v USING (case_id) WHERE contribution > 0.5 AND reason <> 'CUSTOMER_DENIED' AND verdict IN ('CONFIRMED_FRAUD', 'FALSE_POSITIVE')""")
def _(spark, sf_dir):
    items = stable(evidence(spark, sf_dir))
    verdicts = items.select("case_id").distinct().select("case_id", status("case_id").alias("verdict"), F.lit(NOW).alias("us"), F.array().cast("array<string>").alias("tokens"))
    own = items.select("case_id", F.lit("").alias("account")).distinct()
    return analytics.feedback(verdicts, fusion.contributions(items), own)[0].drop("us")


@query("x2_narrative", EVIDENCE + r""", z AS (SELECT *, strftime(make_timestamp(us) + INTERVAL 330 MINUTE, '%H:%M') AS hm, CASE reason WHEN 'CREDENTIAL_STUFFING_IP' THEN 'credential stuffing against many customers' WHEN 'PAYEE_NAME_MISMATCH' THEN 'does not match the payee''s name' ELSE replace(lower(reason), '_', ' ') END AS rs FROM w)
SELECT case_id, evidence_id, 'At ' || hm || CASE stage WHEN 'S0_RECON' THEN ' ' || rs || ' was seen' WHEN 'S1_INITIAL_ACCESS' THEN ' a login succeeded from ' || rs WHEN 'S5_POSITIONING' THEN ' a payee was added that ' || rs WHEN 'S6_MONETIZATION' THEN ' a transfer was attempted (' || rs || ')' ELSE ' ' || rs END || ' [' || evidence_id || '].' AS sentence FROM z""")
def _(spark, sf_dir):
    return analytics.narrative(evidence(spark, sf_dir))


def payment_model(spark: SparkSession, sf_dir: str) -> tuple[models.Scorer, DataFrame]:
    """A payment model of a made label, trained on days 1 to 9 and calibrated on 10 and 11, and the payments of later days."""
    e = stable(ordered(events(spark, sf_dir)))
    rows = e.join(features.amounts(e), "event_id").join(features.payees(e), "event_id")
    first = e.agg(F.min("us").alias("first")).first()["first"]
    rows = rows.withColumns({"y": ((F.col("amount_to_median_30d") > 1.5) & (F.col("k") % 3 > 0)).cast("int"), "day": F.floor((F.col("us") - first) / features.DAY) + 1})
    rows = stable(rows)
    scorer = models.fitted(rows.where("day <= 9"), rows.where("day between 10 and 11"), models.PAYMENT, trees=True)
    return scorer, rows.where("day > 11")


@query("m1_payment_model")
def _(spark, sf_dir):
    """The payment model's quality on later days."""
    return models.report(*payment_model(spark, sf_dir))


@query("s6_d12_attributions")
def _(spark, sf_dir):
    """What made the payment model score each later payment as it did: the five strongest features and up to three reasons."""
    scorer, later = payment_model(spark, sf_dir)
    found = attributions.attributed(scorer.model, later, scorer.features, "event_id")
    total = F.aggregate("features", F.col("expected"), lambda s, x: s + x["added"])
    strongest = F.transform(attributions.strongest(), lambda x: F.concat_ws("=", x["feature"], F.round(x["added"], 4).cast("string")))
    return found.select("event_id", "margin", total.alias("sum_of_parts"), F.array_join(strongest, ",").alias("strongest"), F.array_join(attributions.reasons(), ",").alias("reasons"))
