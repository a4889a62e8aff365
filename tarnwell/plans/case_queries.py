"""From detectors to decisions: evidence of all detectors, the cases that it makes, fusion and policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import kind
from ..operators import asof, cases, detectors, features, fusion, graph, joiner, policy
from ..sources.bridge import events, ordered
from ..sources.stable import stable
from .graph_queries import FLOW, NOW, OBS, SEEDS, edge_table, tokens
from .registry import query

ENTITIES = ("customer", "account", "device", "ip", "payee")


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of all detectors over the bridged events, at the rules' own thresholds, with entities, and what the
    graph said of the payee when the event came.

    Feature tables are joined to events by event_id; each detector is a union branch of its own kinds.
    """
    e = stable(ordered(events(spark, sf_dir)))
    seen = stable(asof.sightings(e))
    edges = stable(asof.first_edges(seen))
    skip = stable(asof.excluded_since(edges))
    logins = e.join(features.logins(e), "event_id").join(features.ip_failures(e), "event_id").join(features.account_failures(e), "event_id").join(features.global_failures(e), "event_id")
    devices = stable(features.devices(e))
    control = e.join(devices, "event_id").join(features.challenges(e), "event_id", "left")
    paid = e.join(features.payees(e), "event_id").join(features.amounts(e), "event_id").join(features.transfer_windows(e), "event_id").join(devices, "event_id")
    told = stable(with_standing(spark, stable(paid), seen, edges, skip))
    first = F.row_number().over(features.Window.partitionBy("account", "payee").orderBy("o")) == 1
    scam = detectors.app_scam(told.withColumn("first_payment", first)).select("event_id", F.col("level").alias("app_level"))
    found = [
        detectors.stuffing(stable(logins)), detectors.travel(logins), detectors.account_control(control), detectors.payments(told).drop("amount"),
        detectors.payee_graph(told.join(scam, "event_id", "left")),
    ]
    items = reduce(DataFrame.unionByName, found)
    own = e.select("event_id", "us", "o", "customer", "payee", "amount", F.array("account").alias("own"), F.array_compact(F.array(*ENTITIES)).alias("entities"))
    payee = told.select("event_id", "reputable", "suspicious")
    return join_items(items.join(own, "event_id").join(payee, "event_id", "left").withColumn("evidence_id", F.concat_ws("-", F.col("event_id").cast("string"), "detector")), skip)


def with_standing(spark: SparkSession, rows: DataFrame, seen: DataFrame, edges: DataFrame, skip: DataFrame) -> DataFrame:
    """``rows`` (event_id, o, us, account, payee, ...) with what the graph said of their payee and sender at their own time."""
    ask = lambda who: rows.where(F.col(who).isNotNull()).select(F.concat_ws(":", F.col("event_id").cast("string"), F.lit(who)).alias("ask"), F.col(who).alias("account"), "o", "us")
    asked = stable(ask("payee").unionByName(ask("account")))
    told = stable(asof.standing(seen, asked).join(asof.seed_paths(asof.seed_walks(edges, tokens(spark, SEEDS, "seed"), skip), asked), "ask", "left"))
    event = lambda who: (F.split("ask", ":")[0].cast("long").alias("event_id"), F.split("ask", ":")[1] == who)
    i, of_payee = event("payee")
    odd = (F.col("tenured") < 3) | (F.size("codes") > 0) | F.coalesce(F.col("seed_hops") <= 2, F.lit(False))
    near = F.coalesce(F.col("seed_hops") <= 2, F.lit(False))
    payee = told.where(of_payee).select(i, F.col("age_days").alias("payee_age_days"), (F.col("reputable") & ~near).alias("reputable"), F.col("codes").alias("payee_mule"), "seed_hops", F.when(F.col("paths") == 1, F.col("weakest")).alias("seed_weakest"), odd.alias("suspicious"))
    i, of_sender = event("account")
    return rows.join(payee, "event_id", "left").join(told.where(of_sender).select(i, F.col("codes").alias("sender_mule")), "event_id", "left")


def join_items(evidence: DataFrame, skip: DataFrame) -> DataFrame:
    """``evidence`` (with o, own, entities, payee, reputable, suspicious) with the tokens that join it, as they stood at its time:
    those of ``cases.KINDS`` that are not excluded, without a payee that is reputable."""
    rows = evidence.select("evidence_id", "o", "own", "payee", "reputable", "suspicious", F.explode(F.array_distinct("entities")).alias("token"))
    rows = asof.still(rows.where(kind(F.col("token")).isin(*cases.KINDS)), skip)
    bridge = (kind(F.col("token")) == "acct") & ~F.array_contains("own", F.col("token"))
    rows = rows.withColumn("bridge", bridge).where(~(F.col("bridge") & F.coalesce("reputable", F.lit(False))))
    listed = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("token"))))
    found = rows.groupBy("evidence_id").agg(listed(F.lit(True)).alias("tokens"), listed(F.col("bridge")).alias("bridges"), listed(F.col("bridge") & F.coalesce("suspicious", F.lit(False))).alias("odd"))
    none = F.array().cast("array<string>")
    out = evidence.drop("o", "payee", "reputable", "suspicious").join(found, "evidence_id", "left")
    return out.withColumns({c: F.coalesce(c, none) for c in ("tokens", "bridges", "odd")} | {"weight": fusion.weight(F.col("p"), F.col("reliability"))})


def cased(spark: SparkSession, sf_dir: str, evidence: DataFrame, deep: bool = False) -> DataFrame:
    """``evidence`` with the case of each item; ``deep`` joins by what lies near an item's tokens too."""
    edges = edge_table(spark, sf_dir)
    standing, skip = stable(graph.reputation(edges, NOW)), stable(graph.excluded(edges))
    good = standing.where("reputable").select(F.col("account").alias("token"))
    odd = standing.where("tenured < 3").select(F.col("account").alias("token")).unionByName(graph.mule_signals(edges, NOW, skip).select(F.col("account").alias("token"))).distinct()
    evidence = stable(evidence)
    near = cases.neighbours(edges, evidence.select(F.explode("entities").alias("token")), skip) if deep else None
    return cases.joined(evidence, cases.links(cases.join_tokens(evidence, skip, good, near), odd))


def sample_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item for every event, as simple as SQL can say it, to compare the joining alone."""
    stage = F.when(F.col("kind") == "transaction", "S6_MONETIZATION").when(F.col("kind") == "payee_added", "S5_POSITIONING").when(F.col("kind") == "login", "S1_INITIAL_ACCESS").otherwise("S2_CONTROL_TAKEOVER")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("evidence_id"), "us", "customer", stage.alias("stage"), (0.004 + (F.col("k") % 23) * 0.0021).alias("p"),
        F.array("account").alias("own"), F.array_compact(F.array("customer", "account", "device", "payee")).alias("entities"),
    )


JOIN = OBS + FLOW.format(days=30) + f""", rp AS (SELECT account, payers, tenured, fresh, outbound, age FROM (SELECT dst AS account, count(*) AS payers, count(*) FILTER (WHERE first <= {NOW} - 604800000000) AS tenured, count(*) FILTER (WHERE first >= {NOW} - 86400000000) AS fresh
    FROM (SELECT dst, src, min(first_seen) AS first FROM e WHERE edge_type IN ('SENT', 'ADDED_PAYEE') GROUP BY 1, 2) GROUP BY 1) JOIN age USING (account) LEFT JOIN (SELECT src AS account, count(*) FILTER (WHERE first_seen >= {NOW} - 86400000000) AS outbound FROM e WHERE edge_type = 'SENT' GROUP BY 1) USING (account)),
good AS (SELECT account FROM rp WHERE age >= 30 AND tenured >= 3 AND tenured >= 0.5 * payers AND fresh <= 0.5 * payers AND NOT (coalesce(outbound, 0) > 0 AND fresh > 0)),
odd AS (SELECT account FROM rp WHERE tenured < 3 UNION SELECT account FROM c WHERE len(codes) > 0),
it AS (SELECT event_id AS id, us, customer, account, CASE kind WHEN 'transaction' THEN 6 WHEN 'payee_added' THEN 5 WHEN 'login' THEN 1 ELSE 2 END AS stage, 0.004::DOUBLE + (k % 23) * 0.0021::DOUBLE AS p, [customer, account, device, payee] AS es FROM ev),
tk AS (SELECT DISTINCT id, us, customer, stage, p, t AS token, t LIKE 'acct:%' AND t <> account AS bridge FROM (SELECT *, unnest(es) AS t FROM it) WHERE t IS NOT NULL AND t NOT IN (SELECT token FROM hub)),
t2 AS (SELECT * FROM tk WHERE NOT bridge OR token NOT IN (SELECT account FROM good)),
sn AS (SELECT *, lag(id) OVER w AS a, lag(us) OVER w AS au, lag(customer) OVER w AS ac, lag(stage) OVER w AS ast, lag(p) OVER w AS ap, lag(bridge) OVER w AS ab FROM t2 WINDOW w AS (PARTITION BY token ORDER BY us, id)),
lk AS (SELECT a, id AS b FROM (SELECT a, id, count(*) FILTER (WHERE NOT (bridge OR ab)) AS direct, count(*) FILTER (WHERE bridge OR ab) AS bridges, bool_or(token IN (SELECT account FROM odd) AND p > 0.01 AND ap > 0.01) AS odd FROM sn
  WHERE a IS NOT NULL AND (us - au <= 21600000000 OR (customer = ac AND ast >= 2 AND us - au <= 259200000000)) GROUP BY 1, 2) WHERE direct > 0 OR bridges >= 2 OR odd)"""


@query("c1_c3_case_links", JOIN + " SELECT a, b FROM lk")
def _(spark, sf_dir):
    edges = edge_table(spark, sf_dir)
    standing = stable(graph.reputation(edges, NOW))
    skip = stable(graph.excluded(edges))
    odd = standing.where("tenured < 3").select(F.col("account").alias("token")).unionByName(graph.mule_signals(edges, NOW, skip).select(F.col("account").alias("token")))
    good = standing.where("reputable").select(F.col("account").alias("token"))
    return cases.links(cases.join_tokens(sample_evidence(spark, sf_dir), skip, good), odd)


@query("c4_cases", JOIN + """, un AS (SELECT a AS x, b AS y FROM lk UNION SELECT b, a FROM lk),
reach(x, y) USING KEY (x) AS (SELECT id AS x, id AS y FROM it UNION (SELECT u.x, min(r.y) AS y FROM reach r JOIN un u ON u.y = r.x JOIN recurring.reach o ON o.x = u.x WHERE r.y < o.y GROUP BY u.x)),
la AS (SELECT it.*, reach.y AS label FROM it JOIN reach ON reach.x = it.id),
op AS (SELECT label, min((us, id)) FILTER (WHERE p > 0.01) AS o FROM la GROUP BY 1)
SELECT 'case:' || arg_min(id, (us, id)) AS case_id, arg_min(customer, (us, id)) AS anchor, min(us) AS opened_us, max(us) AS last_us, count(*) AS items, count(DISTINCT customer) AS customers FROM la JOIN op USING (label) WHERE o IS NOT NULL AND (us, id) >= o GROUP BY label""")
def _(spark, sf_dir):
    return cases.case_table(cased(spark, sf_dir, sample_evidence(spark, sf_dir))).drop("stages")


@query("c1_near_cases")
def _(spark, sf_dir):
    """Cases of the sample evidence joined by what lies near its tokens too; the graph is that of ``NOW``."""
    return cases.case_table(cased(spark, sf_dir, sample_evidence(spark, sf_dir), deep=True)).withColumn("stages", F.array_join("stages", ","))


def simple_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample evidence with the tokens that join it as of each event."""
    e = stable(ordered(events(spark, sf_dir)))
    seen = stable(asof.sightings(e))
    edges = stable(asof.first_edges(seen))
    skip = stable(asof.excluded_since(edges))
    told = with_standing(spark, e.where("payee is not null"), seen, edges, skip).select(F.col("event_id").alias("evidence_id"), "reputable", "suspicious")
    items = sample_evidence(spark, sf_dir).join(e.select(F.col("event_id").alias("evidence_id"), "o", "payee"), "evidence_id").join(told, "evidence_id", "left")
    families = F.create_map(*[F.lit(x) for kv in (("S6_MONETIZATION", "transaction"), ("S5_POSITIONING", "graph"), ("S1_INITIAL_ACCESS", "identity"), ("S2_CONTROL_TAKEOVER", "device")) for x in kv])
    return join_items(items.withColumns({"evidence_id": F.col("evidence_id").cast("string"), "reliability": F.lit(0.7), "family": F.element_at(families, F.col("stage"))}), skip)


@query("c2_c4_joined_cases")
def _(spark, sf_dir):
    """Cases of the sample evidence joined as it arrives, over the graph as of each event; items and customers of each."""
    items = stable(simple_items(spark, sf_dir))
    own, found = joiner.join_cases(items)
    counts = own.join(items.select("evidence_id", "customer", "us"), "evidence_id").groupBy("case_id").agg(F.count("*").alias("items"), F.countDistinct("customer").alias("customers"), F.min("us").alias("first_us"))
    return found.join(counts, "case_id")


@query("r1_detected_cases")
def _(spark, sf_dir):
    """Every step from events to decisions: detectors over the graph as of each event, joining as evidence arrives, fusion,
    policy; one row per case."""
    items = stable(detected(spark, sf_dir))
    own, found = joiner.join_cases(items)
    items = stable(items.drop("weight", "tokens", "bridges", "odd").join(own, "evidence_id").join(found.select("case_id", "anchor"), "case_id"))
    decided = policy.decisions(fusion.timeline(items))
    last = decided.groupBy("case_id").agg(F.max_by(F.struct("p_attack", "band", "rule", "payment_state", "us"), F.struct("us", "evidence_id")).alias("x"))
    return cases.case_table(items).join(last.select("case_id", "x.p_attack", "x.band", "x.rule", "x.payment_state"), "case_id").withColumn("stages", F.array_join("stages", ","))
