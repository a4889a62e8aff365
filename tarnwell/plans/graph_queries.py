"""Entity-graph queries over the bridged events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, graph
from ..sources.bridge import EVENTS_SQL, events, ordered
from ..sources.stable import stable
from .registry import query

NOW = 1_705_276_800_000_000  # 2024-01-15: a fixed instant inside the events' month
SEEDS = ("dev:31", "dev:172", "acct:77")

OBS = f"""WITH RECURSIVE {EVENTS_SQL},
obs AS (SELECT us, event_id, account AS src, device AS dst, 'LOGGED_IN_FROM' AS edge_type, 0.9 AS confidence FROM ev WHERE kind = 'login' AND result = 'success'
  UNION ALL SELECT us, event_id, device, ip, 'CONNECTED_VIA', 0.5 FROM ev WHERE kind = 'login'
  UNION ALL SELECT us, event_id, customer, account, 'OWNS', 1.0 FROM ev WHERE kind = 'login'
  UNION ALL SELECT us, event_id, account, payee, 'ADDED_PAYEE', 0.9 FROM ev WHERE kind = 'payee_added' AND account <> payee
  UNION ALL SELECT us, event_id, account, payee, 'SENT', 1.0 FROM ev WHERE kind = 'transaction' AND account <> payee),
edges AS (SELECT src, dst, edge_type, CAST(max(confidence) AS DOUBLE) AS confidence, min(us) AS first_seen, max(us) AS last_seen, count(*) AS n FROM obs GROUP BY 1, 2, 3),
own AS (SELECT src AS customer, dst AS account FROM edges WHERE edge_type = 'OWNS'),
bydev AS (SELECT DISTINCT e.dst AS token, own.customer FROM edges e JOIN own ON own.account = e.src WHERE edge_type = 'LOGGED_IN_FROM'),
linked AS (SELECT token, count(DISTINCT customer) AS customers FROM (
  SELECT account AS token, customer FROM own UNION ALL SELECT e.dst, own.customer FROM edges e JOIN own ON own.account = e.src WHERE edge_type IN ('SENT', 'ADDED_PAYEE')
  UNION ALL SELECT e.src, own.customer FROM edges e JOIN own ON own.account = e.dst WHERE edge_type IN ('SENT', 'ADDED_PAYEE')
  UNION ALL SELECT * FROM bydev UNION ALL SELECT e.dst, b.customer FROM edges e JOIN bydev b ON b.token = e.src WHERE edge_type = 'CONNECTED_VIA') GROUP BY 1),
hub AS (SELECT token FROM linked WHERE customers >= 21)"""


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged edges, computed once: every graph query reads them more than once."""
    return stable(graph.merged(graph.observations(events(spark, sf_dir))))


def tokens(spark: SparkSession, values: tuple[str, ...], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


@query("g1_edge_observations", OBS + " SELECT us, event_id, src, dst, edge_type, CAST(confidence AS DOUBLE) AS confidence FROM obs")
def _(spark, sf_dir):
    return graph.observations(events(spark, sf_dir))


@query("g2_edge_merge", OBS + """ SELECT src, dst, edge_type, CAST(max(confidence) AS DOUBLE) AS confidence, min(us) AS first_seen, max(us) AS last_seen, count(*) AS count,
  array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 50), ',') AS ids FROM obs GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    return edge_table(spark, sf_dir).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("g3_shared_devices", OBS + f""", held AS (SELECT DISTINCT e.dst AS device, own.customer FROM edges e JOIN own ON own.account = e.src WHERE edge_type = 'LOGGED_IN_FROM' AND last_seen >= {NOW} - 30 * 86400000000),
few AS (SELECT device FROM held GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20)
SELECT a.customer AS src, b.customer AS dst, count(*) AS devices FROM held a JOIN held b ON a.device = b.device AND a.customer < b.customer WHERE a.device IN (SELECT device FROM few) GROUP BY 1, 2""")
def _(spark, sf_dir):
    return graph.shared_devices(edge_table(spark, sf_dir), NOW)


@query("g5_linked_customers", OBS + " SELECT token, customers, customers >= 21 AS hub FROM linked")
def _(spark, sf_dir):
    return graph.linked_customers(edge_table(spark, sf_dir)).withColumn("hub", F.col("customers") >= graph.HUB)


STEP = """, both_ways AS (SELECT src, dst FROM edges WHERE confidence >= {least} AND confidence > 0 UNION SELECT dst, src FROM edges WHERE confidence >= {least} AND confidence > 0),
step AS (SELECT * FROM both_ways WHERE dst NOT IN (SELECT token FROM hub)),
starts AS ({starts}),
w AS (SELECT start, start AS token, 0 AS hops FROM starts UNION SELECT w.start, s.dst, w.hops + 1 FROM w JOIN step s ON s.src = w.token WHERE w.hops < {hops}),
near AS (SELECT start, token, min(hops) AS hops FROM w GROUP BY 1, 2)"""
CUSTOMERS = "SELECT DISTINCT customer AS start FROM ev"


@query("g7_bounded_walk", OBS + STEP.format(least=0.5, hops=2, starts=CUSTOMERS) + " SELECT start, token, hops FROM near WHERE hops > 0")
def _(spark, sf_dir):
    edges = edge_table(spark, sf_dir)
    starts = events(spark, sf_dir).select(F.col("customer").alias("start")).distinct()
    return graph.walk(edges, starts, 2, 0.5, graph.excluded(edges))


@query("g8_seed_distance", OBS + STEP.format(least=0.0, hops=3, starts=CUSTOMERS) + f""", hit AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, token) AS r FROM near WHERE token IN {SEEDS})
SELECT start, hops, token AS seed FROM hit WHERE r = 1""")
def _(spark, sf_dir):
    edges = edge_table(spark, sf_dir)
    starts = events(spark, sf_dir).select(F.col("customer").alias("start")).distinct()
    return graph.seed_distance(edges, starts, tokens(spark, SEEDS, "seed"), graph.excluded(edges))


@query("g10_g14_flow_profile", OBS + f""", e AS (SELECT *, CASE WHEN last_seen <= {NOW} THEN last_seen ELSE first_seen END AS last FROM edges WHERE first_seen <= {NOW}),
p AS (SELECT dst AS account, src, min(first_seen) AS first, max(last) AS last, min(first_seen) FILTER (WHERE edge_type = 'SENT') AS money, max(confidence * pow(0.5, (({NOW} - last) / 3600000000.0) / 72.0)) AS weight FROM e WHERE edge_type IN ('SENT', 'ADDED_PAYEE') GROUP BY 1, 2),
i AS (SELECT account, count(*) AS payers, count(*) FILTER (WHERE last >= {NOW} - 86400000000) AS u, count(*) FILTER (WHERE first >= {NOW} - 86400000000) AS n, count(*) FILTER (WHERE money >= {NOW} - 86400000000) AS m, sum(weight) AS w FROM p GROUP BY 1),
o AS (SELECT src AS account, count(*) AS b, count(*) FILTER (WHERE first_seen >= {NOW} - 86400000000) AS nb FROM e WHERE edge_type = 'SENT' GROUP BY 1),
a AS (SELECT account, min(first_seen) AS f FROM (SELECT src AS account, first_seen FROM e UNION ALL SELECT dst, first_seen FROM e) WHERE account LIKE 'acct:%' GROUP BY 1)
SELECT account, round(({NOW} - f) / 86400000000.0, 6) AS account_age_days, coalesce(payers, 0) AS payers, coalesce(u, 0) AS unique_payers_window, coalesce(n, 0) AS new_payers_window, coalesce(m, 0) AS new_money_payers_window,
  round(coalesce(w, 0.0), 6) AS decayed_fan_in, coalesce(b, 0) AS beneficiaries, coalesce(nb, 0) AS new_beneficiaries_window FROM a LEFT JOIN i USING (account) LEFT JOIN o USING (account)""")
def _(spark, sf_dir):
    return graph.flow_profile(edge_table(spark, sf_dir), NOW)


@query("g10_pass_through", OBS + f""", t AS (SELECT src, dst, unnest([first_seen, last_seen]) AS us FROM edges WHERE edge_type = 'SENT' AND first_seen <= {NOW}),
r AS (SELECT * FROM t WHERE us BETWEEN {NOW} - 86400000000 AND {NOW})
SELECT o.src AS account, round(min((o.us - i.us) / 60000000.0), 6) AS pass_through_min FROM r o JOIN r i ON i.dst = o.src AND i.us <= o.us GROUP BY 1""")
def _(spark, sf_dir):
    return graph.pass_through(edge_table(spark, sf_dir), NOW)


@query("g16_payee_reputation", OBS + f""", e AS (SELECT * FROM edges WHERE first_seen <= {NOW}),
p AS (SELECT dst AS account, src, min(first_seen) AS first FROM e WHERE edge_type IN ('SENT', 'ADDED_PAYEE') GROUP BY 1, 2),
i AS (SELECT account, count(*) AS payers, count(*) FILTER (WHERE first <= {NOW} - 7 * 86400000000) AS tenured, count(*) FILTER (WHERE first >= {NOW} - 86400000000) AS fresh FROM p GROUP BY 1),
o AS (SELECT src AS account, count(*) FILTER (WHERE first_seen >= {NOW} - 86400000000) AS outbound FROM e WHERE edge_type = 'SENT' GROUP BY 1),
a AS (SELECT account, ({NOW} - min(first_seen)) / 86400000000.0 AS age_days FROM (SELECT src AS account, first_seen FROM e UNION ALL SELECT dst, first_seen FROM e) GROUP BY 1)
SELECT account, payers, tenured, fresh, round(age_days, 6) AS age_days, coalesce(outbound, 0) AS outbound,
  age_days >= 10 AND tenured >= 3 AND tenured >= 0.5 * payers AND fresh <= 0.5 * payers AND NOT (coalesce(outbound, 0) > 0 AND fresh > 0) AS reputable FROM i JOIN a USING (account) LEFT JOIN o USING (account)""")
def _(spark, sf_dir):
    return graph.reputation(edge_table(spark, sf_dir), NOW, age_days=10.0)


@query("g17_shared_ips", f"""WITH {EVENTS_SQL}, lg AS (SELECT * FROM ev WHERE kind = 'login'),
c AS (SELECT a.event_id, count(DISTINCT b.device) AS d, count(DISTINCT b.account) FILTER (WHERE b.result = 'success') AS n FROM lg a JOIN lg b ON b.ip = a.ip AND (b.us, b.event_id) <= (a.us, a.event_id) AND b.us >= a.us - 86400000000 GROUP BY 1)
SELECT event_id, d AS ip_devices, n AS ip_accounts, d >= 8 OR n >= 6 AS shared_ip FROM c""")
def _(spark, sf_dir):
    return graph.shared_ips(ordered(events(spark, sf_dir)))


#: The flow shape of accounts in SQL, for the signals that hang on it.
FLOW = f""", e AS (SELECT *, CASE WHEN last_seen <= {NOW} THEN last_seen ELSE first_seen END AS last FROM edges WHERE first_seen <= {NOW}),
p AS (SELECT dst AS account, src, min(first_seen) FILTER (WHERE edge_type = 'SENT') AS money FROM e WHERE edge_type IN ('SENT', 'ADDED_PAYEE') GROUP BY 1, 2),
fr AS (SELECT account, count(*) FILTER (WHERE money >= {NOW} - 86400000000) AS fresh FROM p GROUP BY 1),
nb AS (SELECT src AS account, count(*) FILTER (WHERE first_seen >= {NOW} - 86400000000) AS nb FROM e WHERE edge_type = 'SENT' GROUP BY 1),
ends AS (SELECT src AS account, first_seen, last FROM e WHERE src LIKE 'acct:%' UNION ALL SELECT dst, first_seen, last FROM e WHERE dst LIKE 'acct:%'),
age AS (SELECT account, ({NOW} - min(first_seen)) / 86400000000.0 AS age, min(first_seen) <= {NOW} - {{days}} * 86400000000 AND NOT bool_or((first_seen > {NOW} - {{days}} * 86400000000 AND first_seen < {NOW} - 86400000000) OR (last > {NOW} - {{days}} * 86400000000 AND last < {NOW} - 86400000000)) AS idle FROM ends GROUP BY 1),
tm AS (SELECT src, dst, unnest([first_seen, last_seen]) AS us FROM edges WHERE edge_type = 'SENT' AND first_seen <= {NOW}),
tr AS (SELECT * FROM tm WHERE us BETWEEN {NOW} - 86400000000 AND {NOW}),
pt AS (SELECT o.src AS account, min((o.us - i.us) / 60000000.0) AS gap FROM tr o JOIN tr i ON i.dst = o.src AND i.us <= o.us GROUP BY 1),
f AS (SELECT age.*, coalesce(fresh, 0) AS fresh, coalesce(nb, 0) AS nb, coalesce(fresh, 0) >= 2 AND coalesce(gap <= 180, false) AS passing FROM age LEFT JOIN fr USING (account) LEFT JOIN nb USING (account) LEFT JOIN pt USING (account) WHERE account NOT IN (SELECT token FROM hub)),
fed AS (SELECT DISTINCT s.dst AS account FROM e s JOIN f ON f.account = s.src AND f.passing WHERE s.edge_type = 'SENT' AND s.first_seen >= {NOW} - 14400000000),
lg AS (SELECT DISTINCT src AS account, dst AS device, fresh FROM e JOIN f ON f.account = e.src WHERE edge_type = 'LOGGED_IN_FROM' AND fresh >= 1 AND dst NOT IN (SELECT token FROM hub)),
pr AS (SELECT DISTINCT a.account, a.fresh, b.account AS sibling, b.fresh AS others FROM lg a JOIN lg b ON a.device = b.device AND a.account <> b.account),
ring AS (SELECT account, count(*) + 1 AS members, any_value(fresh) + sum(others) AS payers FROM pr GROUP BY 1),
c AS (SELECT account, list_filter([CASE WHEN members >= 2 AND ring.payers >= 4 THEN 'MULE_RING' END, CASE WHEN passing THEN 'MULE_PASS_THROUGH' END, CASE WHEN account IN (SELECT account FROM fed) THEN 'MULE_RAPID_HOPS' END,
  CASE WHEN nb >= 3 AND fresh >= 1 THEN 'MULE_FAN_OUT' END, CASE WHEN idle AND fresh >= 3 THEN 'MULE_DORMANT_ACTIVATED' END, CASE WHEN age < 7 AND fresh >= 3 THEN 'MULE_FAN_IN_NEW_ACCOUNT' END], lambda x: x IS NOT NULL) AS codes FROM f LEFT JOIN ring USING (account))"""


@query("g11_g12_mule_signals", OBS + FLOW.format(days=30) + " SELECT account, array_to_string(codes, ',') AS codes FROM c WHERE len(codes) > 0")
def _(spark, sf_dir):
    edges = edge_table(spark, sf_dir)
    return graph.mule_signals(edges, NOW, graph.excluded(edges)).select("account", F.array_join("codes", ",").alias("codes"))


@query("g11_dormant_accounts", OBS + FLOW.format(days=3) + " SELECT account FROM age WHERE idle")
def _(spark, sf_dir):
    return graph.dormant(edge_table(spark, sf_dir), NOW, days=3)


#: Facts and questions in the order of events, o: what the graph said of a payee when the event came.
ASOF = OBS + """, num AS (SELECT event_id, us::HUGEINT * 2097152 + row_number() OVER (PARTITION BY us ORDER BY event_id) - 1 AS o FROM ev),
sn AS (SELECT obs.*, o FROM obs JOIN num USING (event_id)), fe AS (SELECT src, dst, edge_type, CAST(max(confidence) AS DOUBLE) AS c, min(o) AS since FROM sn GROUP BY 1, 2, 3),
q AS (SELECT event_id, us, o, payee AS account FROM ev JOIN num USING (event_id) WHERE payee IS NOT NULL)"""
HUBS = """, ow AS (SELECT src AS customer, dst AS account, since AS owned FROM fe WHERE edge_type = 'OWNS'),
bd AS (SELECT fe.dst AS token, customer, min(greatest(since, owned)) AS since FROM fe JOIN ow ON ow.account = fe.src WHERE edge_type = 'LOGGED_IN_FROM' GROUP BY 1, 2),
lk AS (SELECT account AS token, customer, owned AS since FROM ow UNION ALL SELECT * FROM bd
  UNION ALL SELECT fe.dst, customer, greatest(since, owned) FROM fe JOIN ow ON ow.account = fe.src WHERE edge_type IN ('SENT', 'ADDED_PAYEE')
  UNION ALL SELECT fe.src, customer, greatest(since, owned) FROM fe JOIN ow ON ow.account = fe.dst WHERE edge_type IN ('SENT', 'ADDED_PAYEE')
  UNION ALL SELECT fe.dst, customer, greatest(fe.since, bd.since) FROM fe JOIN bd ON bd.token = fe.src WHERE edge_type = 'CONNECTED_VIA'),
hs AS (SELECT token, since AS gone FROM (SELECT token, since, row_number() OVER (PARTITION BY token ORDER BY since) AS n FROM (SELECT token, customer, min(since) AS since FROM lk GROUP BY 1, 2)) WHERE n = 21)"""


def asked_payees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sightings of all events, and each event's payee as a question."""
    e = stable(ordered(events(spark, sf_dir)))
    return stable(asof.sightings(e)), e.where("payee is not null").select(F.col("event_id").alias("ask"), F.col("payee").alias("account"), "o", "us")


@query("g5_hubs_since", ASOF + HUBS + " SELECT token, CAST(floor(gone / 2097152) AS BIGINT) AS since_us FROM hs")
def _(spark, sf_dir):
    found = asof.excluded_since(asof.first_edges(asked_payees(spark, sf_dir)[0]))
    return found.select("token", F.floor(F.col("since") / 2097152).cast("long").alias("since_us"))


@query("g16_standing_asof", ASOF + """, pf AS (SELECT dst AS account, src, min(o) AS o, min(us) AS us FROM sn WHERE edge_type IN ('SENT', 'ADDED_PAYEE') GROUP BY 1, 2),
mf AS (SELECT dst AS account, src, min(o) AS o, min(us) AS us FROM sn WHERE edge_type = 'SENT' GROUP BY 1, 2), bf AS (SELECT src AS account, dst, min(o) AS o, min(us) AS us FROM sn WHERE edge_type = 'SENT' GROUP BY 1, 2),
fa AS (SELECT account, o, us, 1 AS payer, 0 AS money, 0 AS ben FROM pf UNION ALL SELECT account, o, us, 0, 1, 0 FROM mf UNION ALL SELECT account, o, us, 0, 0, 1 FROM bf),
bn AS (SELECT account, min(us) AS us FROM (SELECT src AS account, us FROM sn WHERE src LIKE 'acct:%' UNION ALL SELECT dst, us FROM sn WHERE dst LIKE 'acct:%') GROUP BY 1),
lg AS (SELECT dst AS account, o, us, us AS came FROM sn WHERE edge_type = 'SENT' UNION ALL SELECT src, o, us, NULL FROM sn WHERE edge_type = 'SENT'),
gp AS (SELECT account, o, us, came, (us - max(came) OVER (PARTITION BY account ORDER BY o ROWS UNBOUNDED PRECEDING)) / 60000000.0 AS gap FROM lg),
ct AS (SELECT event_id, coalesce(sum(payer), 0) AS payers, coalesce(sum(payer) FILTER (WHERE fa.us <= q.us - 604800000000), 0) AS tenured, coalesce(sum(payer) FILTER (WHERE fa.us >= q.us - 86400000000), 0) AS fresh,
  coalesce(sum(money) FILTER (WHERE fa.us >= q.us - 86400000000), 0) AS fresh_money, coalesce(sum(ben) FILTER (WHERE fa.us >= q.us - 86400000000), 0) AS outbound FROM q LEFT JOIN fa ON fa.account = q.account AND fa.o <= q.o GROUP BY 1),
pt AS (SELECT event_id, min(gap) AS gap FROM q JOIN gp ON gp.account = q.account AND gp.o <= q.o AND gp.us >= q.us - 86400000000 AND gp.came IS NULL GROUP BY 1),
al AS (SELECT q.event_id, q.account, payers, tenured, fresh, fresh_money, outbound, (q.us - bn.us) / 86400000000.0 AS age, gap FROM q JOIN ct USING (event_id) LEFT JOIN pt USING (event_id) LEFT JOIN bn ON bn.account = q.account AND bn.us <= q.us)
SELECT event_id AS ask, account, CAST(payers AS BIGINT) AS payers, CAST(tenured AS BIGINT) AS tenured, CAST(fresh AS BIGINT) AS fresh, CAST(fresh_money AS BIGINT) AS fresh_money, CAST(outbound AS BIGINT) AS outbound, round(age, 6) AS age_days, round(gap, 6) AS pass_through_min,
  coalesce(age >= 10 AND tenured >= 3 AND tenured >= 0.5 * payers AND fresh <= 0.5 * payers AND NOT (outbound > 0 AND fresh > 0), false) AS reputable,
  array_to_string(list_filter([CASE WHEN fresh_money >= 2 AND gap <= 180 THEN 'MULE_PASS_THROUGH' END, CASE WHEN outbound >= 3 AND fresh_money >= 1 THEN 'MULE_FAN_OUT' END, CASE WHEN age < 7 AND fresh_money >= 3 THEN 'MULE_FAN_IN_NEW_ACCOUNT' END], lambda x: x IS NOT NULL), ',') AS codes FROM al""")
def _(spark, sf_dir):
    seen, asked = asked_payees(spark, sf_dir)
    return asof.standing(seen, asked, age_days=10.0).withColumn("codes", F.array_join("codes", ","))


@query("g8_seed_paths", ASOF + HUBS + f""", st AS (SELECT src AS a, dst AS b, c, since FROM fe UNION ALL SELECT dst, src, c, since FROM fe),
wk(token, hops, path, weakest, since, until) AS (SELECT seed, 0, [seed], 1.0::DOUBLE, 0::HUGEINT, 100000000000000000000000000000::HUGEINT FROM (VALUES {", ".join(f"('{s}')" for s in SEEDS)}) s(seed)
  UNION ALL SELECT st.b, hops + 1, list_prepend(st.b, path), least(weakest, st.c), greatest(wk.since, st.since), least(wk.until, coalesce(hs.gone, wk.until)) FROM wk JOIN st ON st.a = wk.token LEFT JOIN hs ON hs.token = wk.token
    WHERE hops < 3 AND NOT list_contains(path, st.b) AND greatest(wk.since, st.since) < least(wk.until, coalesce(hs.gone, wk.until))),
th AS (SELECT event_id, hops, path, max(weakest) AS weakest FROM q JOIN wk ON wk.token = q.account AND wk.since <= q.o AND q.o < wk.until GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hops, path) AS n, min(hops) OVER (PARTITION BY event_id) AS near FROM th)
SELECT event_id AS ask, near AS seed_hops, count(*) AS paths, arg_min(weakest, n) AS weakest, array_to_string(arg_min(path, n), ' > ') AS path FROM rk WHERE hops = near AND n <= 2 GROUP BY 1, 2""")
def _(spark, sf_dir):
    """Up to two shortest paths from each payee to a seed, over the graph as of its event."""
    seen, asked = asked_payees(spark, sf_dir)
    edges = stable(asof.first_edges(seen))
    walks = asof.seed_walks(edges, tokens(spark, SEEDS, "seed"), asof.excluded_since(edges))
    return asof.seed_paths(walks, asked).withColumn("path", F.array_join("path", " > "))
