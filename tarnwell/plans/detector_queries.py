"""Detector, enrichment and join queries. SQL of features is shared with :mod:`feature_queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import detectors, enrich, features, reports, state
from ..sources import files
from ..sources.bridge import EVENTS_SQL, events, ordered, table
from ..sources.stable import shared_folder
from . import feature_queries as fq
from .registry import query

KEY = bytes(range(32))


def with_features(spark: SparkSession, sf_dir: str, *functions) -> DataFrame:
    rows = base = ordered(events(spark, sf_dir))
    for f in functions:
        rows = rows.join(f(base), "event_id")
    return rows


def features_sql(**parts: str) -> str:
    return ", ".join(f"{name} AS ({sql})" for name, sql in parts.items())


def shown(found: DataFrame, *more: str) -> DataFrame:
    return found.select("event_id", "detector", "family", "stage", "p", "reliability", F.array_join("reasons", ",").alias("reasons"), *more)


RULES = """SELECT event_id, '{detector}' AS detector, '{family}' AS family, '{stage}' AS stage, round(max(greatest(0.0001, least(0.9999, p))), 6) AS p, {trust}::DOUBLE AS reliability, string_agg(code, ',' ORDER BY p DESC, code) AS reasons{more} FROM hits GROUP BY event_id HAVING max(p) >= 0.02"""

SQL_STUFFING = f"""WITH ip AS ({fq.SQL_IP}), ac AS ({fq.SQL_ACCOUNTS}), gl AS ({fq.SQL_GLOBAL}), {EVENTS_SQL},
x AS (SELECT * FROM ev JOIN ip USING (event_id) JOIN ac USING (event_id) JOIN gl USING (event_id) WHERE result = 'failure'),
hits AS (SELECT event_id, 'CREDENTIAL_STUFFING_IP' AS code, 0.04::DOUBLE AS p FROM x WHERE ip_failed_customers_1h >= 2
  UNION ALL SELECT event_id, 'ACCOUNT_DISTRIBUTED_FAILURES', 0.04 * CASE WHEN global_spike THEN 1.5 ELSE 1.0 END FROM x WHERE acct_fail_1h >= 2 AND acct_fail_sources_1h >= 3
  UNION ALL SELECT event_id, 'ACCOUNT_LOW_SLOW_FAILURES', 0.03 * CASE WHEN global_spike THEN 1.5 ELSE 1.0 END FROM x WHERE acct_fail_24h >= 2 AND acct_fail_ips_24h >= 2 AND acct_max_fail_per_ip_24h BETWEEN 1 AND 2
  UNION ALL SELECT event_id, 'DEVICE_MULTI_ACCOUNT_FAILURES', 0.05 * CASE WHEN global_spike THEN 1.5 ELSE 1.0 END FROM x WHERE dev_accounts_1h >= 2 AND dev_fail_1h >= 1
  UNION ALL SELECT event_id, 'GLOBAL_LOGIN_FAILURE_SPIKE', 0.03 FROM x WHERE global_spike)
""" + RULES.format(detector="netsec", family="cyber", stage="S0_RECON", trust="0.5", more="")


@query("d2_credential_stuffing", SQL_STUFFING)
def _(spark, sf_dir):
    rows = with_features(spark, sf_dir, features.ip_failures, features.account_failures, lambda e: features.global_failures(e, least=2))
    return shown(detectors.stuffing(rows, customers=2, failures=2, day_failures=2, day_ips=2, device_accounts=2, device_failures=1))


@query("d3_impossible_travel", f"WITH l AS ({fq.SQL_LOGINS}), hits AS (SELECT event_id, 'IMPOSSIBLE_TRAVEL' AS code, 0.08::DOUBLE AS p FROM l WHERE travel_speed_kmh > 40) " + RULES.format(detector="behaviour", family="identity", stage="S1_INITIAL_ACCESS", trust="0.6", more=""))
def _(spark, sf_dir):
    return shown(detectors.travel(with_features(spark, sf_dir, features.logins), speed=40.0))


@query("d5_account_control", f"""WITH dv AS ({fq.SQL_DEVICES}), ch AS ({fq.SQL_CHALLENGES}), {EVENTS_SQL}, x AS (SELECT * FROM ev JOIN dv USING (event_id) LEFT JOIN ch USING (event_id)),
hits AS (SELECT event_id, 'MFA_CHANGED_AFTER_NEW_DEVICE' AS code, 0.06::DOUBLE AS p FROM x WHERE kind = 'mfa_change' AND minutes_since_new_device <= 2880 UNION ALL SELECT event_id, 'MFA_FAIL_THEN_PASS', 0.04 FROM x WHERE result = 'passed' AND mfa_fails_15m >= 1
  UNION ALL SELECT event_id, 'PUSH_SPAM', 0.06 FROM x WHERE push_rejects_10m >= 1) """ + RULES.format(detector="auth", family="device", stage="S2_CONTROL_TAKEOVER", trust="0.7", more=""))
def _(spark, sf_dir):
    rows = ordered(events(spark, sf_dir))
    rows = rows.join(features.devices(rows), "event_id").join(features.challenges(rows), "event_id", "left")
    return shown(detectors.account_control(rows, minutes=2880.0, fails=1, pushes=1))


PAYMENTS = f"am AS ({fq.SQL_AMOUNTS}), py AS ({fq.SQL_PAYEES}), tw AS ({fq.SQL_TRANSFERS}), dv AS ({fq.SQL_DEVICES})"


@query("d12_d13_payments", f"""WITH {PAYMENTS}, {EVENTS_SQL}, x AS (SELECT *, amount_to_median_30d > 5 AND payee_is_new AS high FROM ev JOIN am USING (event_id) JOIN py USING (event_id) JOIN tw USING (event_id)),
hits AS (SELECT event_id, amount, CASE WHEN high THEN 'DEGRADED_HIGH' ELSE 'DEGRADED_LOW' END AS code, CASE WHEN high THEN 0.15::DOUBLE ELSE 0.005::DOUBLE END AS p FROM x
  UNION ALL SELECT event_id, amount, 'STRUCTURING', CASE WHEN tw_near_limit_limit_paise > 0 AND tw_near_limit_same_limit_max_24h >= 2 AND tw_pair_sum_24h_paise >= tw_near_limit_limit_paise THEN 0.3 ELSE 0.12 END FROM x WHERE tw_near_limit_count_24h >= 2) """ + RULES.format(detector="txn", family="transaction", stage="S6_MONETIZATION", trust="0.85", more=", any_value(amount) AS amount"))
def _(spark, sf_dir):
    return shown(detectors.payments(with_features(spark, sf_dir, features.amounts, features.payees, features.transfer_windows)), "amount")


@query("d11_app_scam", f"""WITH {PAYMENTS}, {EVENTS_SQL},
first AS (SELECT account, payee, min((us, event_id)) AS m FROM ev WHERE kind = 'transaction' GROUP BY 1, 2),
x AS (SELECT ev.event_id, amount_to_median_30d AS r, payee_fan_in_24h AS fan, minutes_since_mfa_change AS a, minutes_since_new_device AS b, first.m = (us, ev.event_id) AS fp FROM ev JOIN am USING (event_id) JOIN py USING (event_id) JOIN dv USING (event_id) JOIN first USING (account, payee)),
s AS (SELECT event_id, round(CASE WHEN fp THEN 0.10 ELSE 0 END + CASE WHEN r >= 10 THEN 0.25 WHEN r >= 3 THEN 0.15 ELSE 0 END + CASE WHEN fan >= 5 THEN 0.35 WHEN fan >= 2 THEN 0.20 ELSE 0 END + CASE WHEN least(a, b) < 4320 THEN 0.10 ELSE 0 END, 4)::DOUBLE AS score FROM x WHERE b >= 1440)
SELECT event_id, score, CASE WHEN score >= 0.70 THEN 'APP_SCAM_COOLING_OFF' WHEN score >= 0.45 THEN 'APP_SCAM_WARNING' ELSE 'NONE' END AS level FROM s""")
def _(spark, sf_dir):
    rows = with_features(spark, sf_dir, features.amounts, features.payees, features.devices)
    first = F.row_number().over(features.Window.partitionBy("account", "payee").orderBy("us", "event_id")) == 1
    return detectors.app_scam(rows.withColumn("first_payment", first)).drop("signs")


DEFAULTS = {"ip_failed_customers_1h >= 2": "ip_failed_customers_1h >= 10", "acct_fail_1h >= 2 AND": "acct_fail_1h >= 5 AND", "acct_fail_24h >= 2 AND acct_fail_ips_24h >= 2": "acct_fail_24h >= 6 AND acct_fail_ips_24h >= 4", "dev_accounts_1h >= 2 AND dev_fail_1h >= 1": "dev_accounts_1h >= 4 AND dev_fail_1h >= 3"}


def with_defaults(sql: str) -> str:
    for low, own in DEFAULTS.items():
        assert low in sql
        sql = sql.replace(low, own)
    return sql.replace(fq.SQL_GLOBAL, fq.SQL_GLOBAL_DEFAULT)


@query("d2_stuffing_as_set", with_defaults(SQL_STUFFING))
def _(spark, sf_dir):
    """The rule's own thresholds."""
    return shown(detectors.stuffing(with_features(spark, sf_dir, features.ip_failures, features.account_failures, features.global_failures)))


@query("d3_travel_as_set", f"WITH l AS ({fq.SQL_LOGINS}), hits AS (SELECT event_id, 'IMPOSSIBLE_TRAVEL' AS code, 0.08::DOUBLE AS p FROM l WHERE travel_speed_kmh > 900) " + RULES.format(detector="behaviour", family="identity", stage="S1_INITIAL_ACCESS", trust="0.6", more=""))
def _(spark, sf_dir):
    return shown(detectors.travel(with_features(spark, sf_dir, features.logins)))


#: Events of the kinds that the tables do not hold, as step-up results, SIM signals and profile changes by k.
CONTROL = """y AS (SELECT * REPLACE (CASE k % 7 WHEN 1 THEN 'step_up_result' WHEN 2 THEN 'sim_signal' WHEN 3 THEN 'profile_change' ELSE kind END AS kind,
  CASE WHEN k % 7 = 1 THEN ['passed', 'failed', 'timeout', 'denied_by_customer'][CAST(event_id % 4 AS INTEGER) + 1] ELSE result END AS result),
  event_id % 150 AS factor_age_h, event_id % 200 AS sim_change_age_h, k % 11 = 0 AS session_change, CASE WHEN k % 22 = 0 THEN 67 ELSE 5 END AS session_mask, k % 4 AS device_mask FROM ev)"""


@query("d5_d6_account_control", f"""WITH dv AS ({fq.SQL_DEVICES}), ch AS ({fq.SQL_CHALLENGES}), {EVENTS_SQL}, {CONTROL}, x AS (SELECT y.*, dv.minutes_since_new_device, ch.mfa_fails_15m, ch.push_rejects_10m, y.kind IN ('payee_added', 'transaction') AS only_session FROM y JOIN dv USING (event_id) LEFT JOIN ch USING (event_id)),
main AS (SELECT event_id, 'MFA_CHANGED_AFTER_NEW_DEVICE' AS code, 0.06::DOUBLE AS p FROM x WHERE kind = 'mfa_change' AND minutes_since_new_device <= 60 UNION ALL SELECT event_id, 'PROFILE_CHANGE_AFTER_NEW_DEVICE', 0.05 FROM x WHERE kind = 'profile_change' AND minutes_since_new_device <= 60
  UNION ALL SELECT event_id, 'MFA_FAIL_THEN_PASS', 0.04 FROM x WHERE kind = 'mfa_challenge' AND result = 'passed' AND mfa_fails_15m >= 2 UNION ALL SELECT event_id, 'PUSH_SPAM', 0.06 FROM x WHERE kind = 'mfa_challenge' AND push_rejects_10m >= 3
  UNION ALL SELECT event_id, 'RECENT_SIM_SWAP', 0.07 FROM x WHERE kind = 'sim_signal' AND sim_change_age_h < 72
  UNION ALL SELECT event_id, CASE result WHEN 'denied_by_customer' THEN 'CUSTOMER_DENIED' WHEN 'passed' THEN CASE WHEN factor_age_h < 72 THEN 'STEP_UP_PASSED_WITH_FRESH_FACTOR' ELSE 'STEP_UP_PASSED_TRUSTED' END ELSE 'STEP_UP_FAILED_OR_TIMEOUT' END,
    CASE result WHEN 'denied_by_customer' THEN 0.01 WHEN 'passed' THEN CASE WHEN factor_age_h < 72 THEN 0.08 ELSE 0.003 END ELSE 0.05 END FROM x WHERE kind = 'step_up_result' AND NOT (result IN ('failed', 'timeout') AND factor_age_h < 72)),
hits AS (SELECT * FROM main UNION ALL SELECT event_id, 'SESSION_CONTEXT_CHANGE', CASE WHEN session_mask = 67 THEN 0.08 ELSE 0.05 END FROM x WHERE session_change AND kind <> 'step_up_result'
  UNION ALL SELECT event_id, 'DEVICE_INCONSISTENT', CASE WHEN device_mask = 3 THEN 0.05 ELSE 0.03 END FROM x WHERE device_mask > 0 AND kind <> 'step_up_result' AND CASE WHEN only_session THEN session_change ELSE event_id IN (SELECT event_id FROM main) END) """
    + RULES.format(detector="auth", family="device", stage="S2_CONTROL_TAKEOVER", trust="0.7", more="") + " OR bool_or(code IN ('STEP_UP_PASSED_TRUSTED', 'CUSTOMER_DENIED'))")
def _(spark, sf_dir):
    """All rules of account control, as they are set."""
    base = ordered(events(spark, sf_dir))
    rows = base.join(features.devices(base), "event_id").join(features.challenges(base), "event_id", "left")
    return shown(detectors.account_control(control_events(rows)))


def control_events(rows: DataFrame) -> DataFrame:
    """Rows with some made step-up results, SIM signals and profile changes, and with session and device context."""
    k, i = F.col("k"), F.col("event_id")
    results = F.get(F.array(*[F.lit(v) for v in ("passed", "failed", "timeout", "denied_by_customer")]), (i % 4).cast("int"))
    return rows.withColumns({
        "kind": F.when(k % 7 == 1, "step_up_result").when(k % 7 == 2, "sim_signal").when(k % 7 == 3, "profile_change").otherwise(F.col("kind")),
        "result": F.when(k % 7 == 1, results).otherwise(F.col("result")),
        "factor_age_h": (i % 150).cast("double"), "sim_change_age_h": (i % 200).cast("double"), "session_change": k % 11 == 0,
        "session_change_mask": F.when(k % 22 == 0, 67).otherwise(5), "device_inconsistency_mask": (k % 4).cast("int"),
    })


@query("d4_login_context", f"""WITH {EVENTS_SQL}, hits AS (SELECT event_id, 'TZ_MISMATCH' AS code, 0.02::DOUBLE AS p FROM ev WHERE kind = 'login' AND k % 3 = 0 UNION ALL SELECT event_id, 'DEVICE_INCONSISTENT', CASE WHEN k % 4 = 3 THEN 0.05 ELSE 0.03 END FROM ev WHERE kind = 'login' AND k % 4 > 0
  UNION ALL SELECT event_id, 'SESSION_CONTEXT_CHANGE', CASE WHEN k % 22 = 0 THEN 0.08 ELSE 0.05 END FROM ev WHERE kind = 'login' AND k % 11 = 0) """ + RULES.format(detector="behaviour", family="identity", stage="S1_INITIAL_ACCESS", trust="0.6", more=""))
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    k = F.col("k")
    context = {"tz_mismatch": k % 3 == 0, "session_change": k % 11 == 0, "session_change_mask": F.when(k % 22 == 0, 67).otherwise(5), "device_inconsistency_mask": (k % 4).cast("int")}
    return shown(detectors.login_context(rows.withColumns(context)))


@query("d9_w18_insider", f"""WITH dv AS ({fq.SQL_DEVICES}), {EVENTS_SQL},
act AS (SELECT event_id, us, customer, 'cid:' || (k % 5) AS staff, ['UpdateTransferLimit', 'ReadCustomerProfile', 'ResetCustomerMfa', 'UnlockAccount'][CAST(k % 4 AS INTEGER) + 1] AS action, CASE WHEN k % 13 = 0 THEN 'failure' ELSE 'success' END AS result FROM ev WHERE kind IN ('mfa_change', 'mfa_challenge')),
many AS (SELECT a.event_id, count(DISTINCT b.customer) AS n FROM act a JOIN act b ON b.staff = a.staff AND (b.us, b.event_id) <= (a.us, a.event_id) AND b.us >= a.us - 3600000000 GROUP BY 1),
lg AS (SELECT account, customer, device, min(us) AS first FROM ev WHERE kind = 'login' AND result = 'success' GROUP BY 1, 2, 3),
nd AS (SELECT a.event_id, bool_or(l.first >= a.us - 7200000000) AND bool_or(l.first <= a.us - 86400000000) AS hit FROM act a JOIN lg l ON l.customer = a.customer AND l.first <= a.us GROUP BY 1),
x AS (SELECT act.*, coalesce(nd.hit, false) AS nd, many.n >= 3 AS many, CAST(floor(((us + 19800000000) % 86400000000) / 3600000000) AS INTEGER) AS hour FROM act JOIN many USING (event_id) LEFT JOIN nd USING (event_id) WHERE action IN ('UpdateTransferLimit', 'ResetCustomerMfa', 'UnlockAccount') AND result <> 'failure'),
hits AS (SELECT event_id, 'INSIDER_CHANGE_AFTER_NEW_DEVICE_LOGIN' AS code, 0.04::DOUBLE AS p FROM x WHERE nd UNION ALL SELECT event_id, 'INSIDER_REPEATED_SENSITIVE_ACTIONS', 0.03 FROM x WHERE many UNION ALL SELECT event_id, 'INSIDER_SENSITIVE_OFF_HOURS', 0.02 FROM x WHERE (nd OR many) AND (hour >= 21 OR hour < 7)) """
    + RULES.format(detector="cyber", family="cyber", stage="S4_ESCALATION", trust="0.5", more=""))
def _(spark, sf_dir):
    rows = ordered(events(spark, sf_dir))
    k = F.col("k")
    names = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    acts = rows.where("kind in ('mfa_change', 'mfa_challenge')").withColumns({
        "staff": F.concat(F.lit("cid:"), k % 5), "action": names(("UpdateTransferLimit", "ReadCustomerProfile", "ResetCustomerMfa", "UnlockAccount"), k % 4), "result": F.when(k % 13 == 0, "failure").otherwise("success"),
    })
    logins = rows.where("kind = 'login' and result = 'success'")
    return shown(detectors.insider(acts.join(features.staff_reads(acts), "event_id").join(features.new_device_logins(acts, logins), "event_id")))


LETTERS = "abcdefghijklmnopqrstuvwxyz234567"
PAD = {x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}


@query("pf1_tokens", f"""WITH v AS (SELECT c_custkey, replace(upper(trim(c_name)), ' ', '') AS n FROM customer),
h AS (SELECT c_custkey, sha256(unhex('{PAD[0x5C]}') || unhex(sha256(unhex('{PAD[0x36]}') || encode('cust:' || n)))) AS d FROM v)
SELECT c_custkey, 'cust:' || list_aggregate(list_transform(range(16), lambda i: substr('{LETTERS}', CAST((('0x' || substr(d, CAST(1 + 10 * (i // 8) AS INTEGER), 10))::BIGINT >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS token FROM h""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.token("cust", F.col("c_name"), KEY).alias("token"))


IPS = "concat_ws('.', CASE k % 4 WHEN 0 THEN '192.0.2' WHEN 1 THEN '198.51.100' WHEN 2 THEN '49.207.10' ELSE '10.1.' || (k % 7) END, CAST(event_id % 256 AS VARCHAR))"


@query("j6_pf5_network_ranges", f"""WITH {EVENTS_SQL}, r AS (SELECT *, {IPS} AS raw FROM ev), n(prefix, network_type, zone, confidence) AS (VALUES ('185.220.101.', 'hosting', 'Europe/Berlin', 0.9), ('192.0.2.', 'vpn', 'Europe/Amsterdam', 0.9), ('198.51.100.', 'tor', 'Europe/Berlin', 0.9), ('203.0.113.', 'hosting', 'America/New_York', 0.9), ('49.207.10.', 'mobile', 'Asia/Kolkata', 0.8), ('103.21.4.', 'mobile', 'Asia/Kolkata', 0.8))
SELECT event_id, raw, network_type, zone, confidence::DOUBLE AS confidence, (CASE network_type WHEN 'tor' THEN 0.2 WHEN 'vpn' THEN 0.3 WHEN 'hosting' THEN 0.3 ELSE 1.0 END)::DOUBLE AS geo FROM r LEFT JOIN n ON starts_with(raw, prefix)""")
def _(spark, sf_dir):
    k = F.col("k")
    block = F.when(k % 4 == 0, "192.0.2").when(k % 4 == 1, "198.51.100").when(k % 4 == 2, "49.207.10").otherwise(F.concat(F.lit("10.1."), k % 7))
    rows = events(spark, sf_dir).select("event_id", F.concat_ws(".", block, (F.col("event_id") % 256).cast("string")).alias("raw"))
    joined = enrich.range_join(rows.withColumn("ip_number", files.ipv4(F.col("raw"))), enrich.network_table(spark))
    return joined.select("event_id", "raw", "network_type", "zone", "confidence", enrich.geo_confidence(F.col("network_type"), F.col("confidence")).alias("geo"))


#: Lines of the files that name networks, and operators by number, for the query below.
PROXY_LINES = ['"167837696","167837951","TOR","-","-"', '"167838208","167838463","DCH","-","-"', '"167838720","167838975","-","-","-"']
CGNAT_LINES = ["# carriers", "10.1.1.128/25  # a half", "10.1.2.0/24", "49.207.10.0/24"]
OPERATORS = {"AS64507": "hosting", "AS64519": "mobile"}


@query("pf5_ordered_sources", f"""WITH {EVENTS_SQL}, r AS (SELECT *, {IPS} AS raw, event_id % 256 AS host, CASE WHEN k % 5 < 3 THEN 'AS' || (64500 + k) END AS hint FROM ev),
s AS (SELECT *, CASE WHEN k % 4 = 3 AND k % 7 = 0 THEN 'ip2proxy tor' WHEN k % 4 = 3 AND k % 7 = 2 THEN 'ip2proxy hosting' WHEN k % 4 < 3 THEN 'demo_list ' || ['vpn', 'tor', 'mobile'][k % 4 + 1]
  WHEN k % 7 = 1 AND host >= 128 THEN 'cgnat_list mobile' WHEN hint = 'AS64507' THEN 'asn_map hosting' WHEN hint = 'AS64519' THEN 'asn_map mobile' ELSE 'special unknown' END AS found FROM r)
SELECT event_id, split_part(found, ' ', 2) AS network_type, split_part(found, ' ', 1) AS network_source, CASE split_part(found, ' ', 1) WHEN 'demo_list' THEN CASE WHEN k % 4 = 2 THEN 0.8 ELSE 0.9 END WHEN 'ip2proxy' THEN 0.8 WHEN 'cgnat_list' THEN 0.6 WHEN 'asn_map' THEN 0.4 ELSE 0.3 END::DOUBLE AS confidence FROM s""")
def _(spark, sf_dir):
    """The network of each event's address by the first source that knows it, of files that are written and read."""
    folder, k = shared_folder(spark), F.col("k")
    for name, text in (("proxies", PROXY_LINES), ("carriers", CGNAT_LINES)):
        spark.createDataFrame([(line,) for line in text], "value string").coalesce(1).write.text(f"{folder}/{name}")
    ranges = {
        "demo_list": enrich.network_table(spark), "ip2proxy": files.proxy_ranges(files.lines(spark, f"{folder}/proxies"), {"TOR": "tor", "DCH": "hosting"}),
        "cgnat_list": files.network_list(files.lines(spark, f"{folder}/carriers")),
    }
    block = F.when(k % 4 == 0, "192.0.2").when(k % 4 == 1, "198.51.100").when(k % 4 == 2, "49.207.10").otherwise(F.concat(F.lit("10.1."), k % 7))
    raw = F.concat_ws(".", block, (F.col("event_id") % 256).cast("string"))
    rows = events(spark, sf_dir).select("event_id", files.ipv4(raw).alias("ip_number"), F.when(k % 5 < 3, F.concat(F.lit("as"), k + 64500)).alias("net_hint"))
    return enrich.networks_known(rows, ranges, OPERATORS).select("event_id", "network_type", "network_source", "confidence")


@query("pf8_zone_mismatch", f"""WITH {EVENTS_SQL}, z AS (SELECT *, ['Asia/Kolkata', 'Europe/Berlin', 'Asia/Colombo'][CAST(k % 3 AS INTEGER) + 1] AS a, ['Asia/Kolkata', 'Europe/Amsterdam'][CAST(k % 2 AS INTEGER) + 1] AS b FROM ev)
SELECT event_id, (a LIKE 'Asia/%') <> (b LIKE 'Asia/%') AS mismatch FROM z""")
def _(spark, sf_dir):
    names = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    a, b = names(("Asia/Kolkata", "Europe/Berlin", "Asia/Colombo"), F.col("k") % 3), names(("Asia/Kolkata", "Europe/Amsterdam"), F.col("k") % 2)
    return events(spark, sf_dir).select("event_id", enrich.zone_mismatch(F.col("us"), a, b).alias("mismatch"))


@query("pf3_validation", f"""WITH {EVENTS_SQL} SELECT event_id, concat_ws(',', CASE WHEN kind = 'transaction' AND coalesce(amount, 0) <= 0 THEN 'amount' END, CASE WHEN kind IN ('transaction', 'payee_added') AND payee IS NULL THEN 'payee' END, CASE WHEN payee = account THEN 'self' END) AS errors FROM ev""")
def _(spark, sf_dir):
    return enrich.errors(events(spark, sf_dir)).select("event_id", F.array_join("errors", ",").alias("errors"))


@query("pf6_asn", f"WITH {EVENTS_SQL} SELECT event_id, 'AS' || (64500 + k) AS asn FROM ev")
def _(spark, sf_dir):
    raw = F.concat(F.when(F.col("k") % 2 == 0, "as00").otherwise("Host AS"), (F.col("k") + 64500).cast("string"), F.lit(" Co"))
    return events(spark, sf_dir).select("event_id", enrich.asn(raw).alias("asn"))


def flags_sql(feature: str, key: str, hit: str) -> str:
    """A flag that a hit raises for an hour and that no hit extends: one step of recursion for each event of a key."""
    return f"""WITH RECURSIVE fx AS ({feature}), {EVENTS_SQL},
r AS MATERIALIZED (SELECT event_id, {key} AS key, us, coalesce({hit}, false) AS hit, row_number() OVER (PARTITION BY {key} ORDER BY us, event_id) AS n FROM ev JOIN fx USING (event_id)),
c AS (SELECT key, n, event_id, false AS flagged, hit AS raised, CASE WHEN hit THEN us END AS since FROM r WHERE n = 1
  UNION ALL SELECT key, n, event_id, up, hit AND NOT up, CASE WHEN hit AND NOT up THEN us ELSE since END FROM (SELECT r.*, c.since, coalesce(r.us - c.since < 3600000000, false) AS up FROM c JOIN r ON r.key = c.key AND r.n = c.n + 1))
SELECT event_id, key, flagged, raised FROM c"""


@query("w16_ip_flags", flags_sql(fq.SQL_IP, "ip", "result = 'failure' AND ip_failed_customers_1h >= 2"))
def _(spark, sf_dir):
    rows = with_features(spark, sf_dir, features.ip_failures)
    return state.rearming_flags(rows, "ip", "result = 'failure' and ip_failed_customers_1h >= 2")


@query("w25_device_flags", flags_sql(fq.SQL_ACCOUNTS, "device", "result = 'failure' AND dev_accounts_1h >= 2"))
def _(spark, sf_dir):
    rows = with_features(spark, sf_dir, features.account_failures)
    return state.rearming_flags(rows, "device", "result = 'failure' and dev_accounts_1h >= 2")


#: First-seen context and reported signatures of each session, carried by recursion from event to event.
SQL_SESSIONS = f"""WITH RECURSIVE {EVENTS_SQL},
r AS MATERIALIZED (SELECT event_id, us, CAST(substr(customer, 6) AS BIGINT) % 60 AS session, asn AS na, CASE WHEN k % 3 = 0 THEN 'mobile' ELSE 'hosting' END AS nt, device AS nd, CASE WHEN k % 2 = 0 THEN 'android' ELSE 'windows' END AS np, customer AS nc,
  concat_ws('|', na, nt, nd, np, nc) AS sig, row_number() OVER (PARTITION BY session ORDER BY us, event_id) AS n FROM ev),
c AS (SELECT session, n, event_id, false AS seen, 0 AS mask, false AS report, na AS a, nt AS t, nd AS d, np AS p, nc AS c, us AS since, CAST([] AS VARCHAR[]) AS told FROM r WHERE n = 1
  UNION ALL SELECT session, n, event_id, live, mask, bad AND NOT list_contains(old, sig), coalesce(oa, na), coalesce(ot, nt), coalesce(od, nd), coalesce(op, np), coalesce(oc, nc), us, CASE WHEN bad AND len(old) < 16 AND NOT list_contains(old, sig) THEN list_append(old, sig) ELSE old END
  FROM (SELECT *, (mask & 3) > 0 AND (mask & 60) > 0 AS bad FROM (SELECT *, m + CASE WHEN (m & 3) > 0 AND nt = 'hosting' AND ot <> 'hosting' THEN 64 ELSE 0 END AS mask
  FROM (SELECT *, CASE WHEN oa <> na THEN 1 ELSE 0 END + CASE WHEN ot <> nt THEN 2 ELSE 0 END + CASE WHEN od <> nd THEN 4 ELSE 0 END + CASE WHEN op <> np THEN 8 ELSE 0 END + CASE WHEN oc <> nc THEN 32 ELSE 0 END AS m
  FROM (SELECT r.*, r.us - c.since <= 86400000000 AS live, CASE WHEN live THEN c.a END AS oa, CASE WHEN live THEN c.t END AS ot, CASE WHEN live THEN c.d END AS od, CASE WHEN live THEN c.p END AS op, CASE WHEN live THEN c.c END AS oc, CASE WHEN live THEN c.told ELSE [] END AS old
  FROM c JOIN r ON r.session = c.session AND r.n = c.n + 1)))))
SELECT event_id, seen AS session_seen, CAST(mask AS INTEGER) AS session_change_mask, report AS session_change FROM c"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the session and the context that :mod:`state` folds; 60 sessions, each of several customers."""
    return events(spark, sf_dir).select(
        "event_id", "us", "asn", "device", "customer", F.concat(F.lit("ses:"), F.regexp_extract("customer", r"(\d+)", 1).cast("long") % 60).alias("session"),
        F.when(F.col("k") % 3 == 0, "mobile").otherwise("hosting").alias("network_type"), F.when(F.col("k") % 2 == 0, "android").otherwise("windows").alias("platform"), F.lit(None).cast("string").alias("gpu"),
    )


@query("w27_sessions", SQL_SESSIONS)
def _(spark, sf_dir):
    return state.sessions(ordered(session_events(spark, sf_dir)))


#: Verdicts of 0 or 1, at most 3 of them a day, decayed to the prior with a half-life of 30 days and kept within 0.2 and 0.95.
SQL_RELIABILITY = f"""WITH RECURSIVE {EVENTS_SQL}, prior(detector, a0, b0) AS (VALUES ('txn', 17.0::DOUBLE, 3.0::DOUBLE), ('auth', 7.0, 3.0), ('graph', 8.0, 2.0)),
v AS (SELECT ['txn', 'auth', 'graph'][k % 3 + 1] AS detector, us, CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS da, event_id FROM ev WHERE kind = 'transaction'),
r AS MATERIALIZED (SELECT v.*, a0, b0, row_number() OVER (PARTITION BY v.detector ORDER BY us, da, 1 - da, event_id) AS n FROM v JOIN prior USING (detector)),
c AS (SELECT detector, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS us, a0 AS a, b0 AS b, CAST([] AS STRUCT(t BIGINT, s DOUBLE)[]) AS used FROM prior
  UNION ALL SELECT detector, n, us, a1 + x, b1 + y, CASE WHEN greatest(x, y) > 0 THEN list_append(kept, struct_pack(t := us, s := greatest(x, y))) ELSE kept END
  FROM (SELECT *, least(da * scale, greatest(0.0, 0.95::DOUBLE * b1 / 0.05::DOUBLE - a1)) AS x, least((1 - da) * scale, greatest(0.0, a1 / 0.2::DOUBLE - a1 - b1)) AS y
  FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0, 3.0::DOUBLE - coalesce(list_sum(list_transform(kept, lambda z: z.s)), 0))) AS scale, a0 + (a - a0) * f AS a1, b0 + (b - b0) * f AS b1
  FROM (SELECT r.*, c.a, c.b, coalesce(pow(0.5::DOUBLE, (r.us - c.us) / 2592000000000.0::DOUBLE), 1) AS f, list_filter(c.used, lambda z: r.us - z.t <= 86400000000) AS kept FROM c JOIN r ON r.detector = c.detector AND r.n = c.n + 1))))
SELECT detector, us, round(a, 6) AS alpha, round(b, 6) AS beta FROM c WHERE n > 0"""


@query("l2_reliability", SQL_RELIABILITY)
def _(spark, sf_dir):
    e = events(spark, sf_dir).where("kind = 'transaction'")
    name = F.get(F.array(*[F.lit(d) for d in ("txn", "auth", "graph")]), (F.col("k") % 3).cast("int"))
    good = F.when(F.col("k") % 4 == 0, 0.0).otherwise(1.0)
    prior = {"txn": (17.0, 3.0), "auth": (7.0, 3.0), "graph": (8.0, 2.0)}
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for d, v in prior.items() for x in (d, v[i])]), F.col("detector"))
    rows = e.select(name.alias("detector"), "us", good.alias("d_alpha"), (1 - good).alias("d_beta"))
    return state.reliability_updates(rows.withColumns({"alpha0": of(0), "beta0": of(1)}))


@query("j7_shared_token_cases", f"""WITH {EVENTS_SQL}, t AS (SELECT DISTINCT customer, unnest([device, ip]) AS token FROM ev)
SELECT DISTINCT a.customer FROM t a WHERE EXISTS (SELECT 1 FROM t b WHERE b.token = a.token AND b.customer <> a.customer)""")
def _(spark, sf_dir):
    tokens = events(spark, sf_dir).select("customer", F.explode(F.array("device", "ip")).alias("token")).distinct()
    # a token held by two customers or more is shared; no pair of holders is made
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    return tokens.join(shared, "token", "left_semi").select("customer").distinct()


@query("j8_as_of_payee", f"""WITH {EVENTS_SQL} SELECT a.event_id, max(b.us) AS added_us FROM ev a LEFT JOIN ev b ON b.kind = 'payee_added' AND b.payee = a.payee AND (b.us, b.event_id) < (a.us, a.event_id) WHERE a.kind = 'transaction' GROUP BY 1""")
def _(spark, sf_dir):
    rows = ordered(events(spark, sf_dir)).where("kind in ('transaction', 'payee_added')")
    over = features.Window.partitionBy("payee").orderBy("o").rowsBetween(features.Window.unboundedPreceding, -1)
    return rows.withColumn("added_us", F.max(F.when(F.col("kind") == "payee_added", F.col("us"))).over(over)).where("kind = 'transaction'").select("event_id", "added_us")


@query("j15_factor_seeding", f"""WITH u AS ({fq.SQL_USUAL}), f(factor) AS (VALUES ('sms'), ('device_push')), {EVENTS_SQL} SELECT c.customer, f.factor, CASE WHEN f.factor = 'device_push' THEN u.device END AS device FROM (SELECT DISTINCT customer FROM ev) c CROSS JOIN f LEFT JOIN u USING (customer)""")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    factors = F.explode(F.array(F.lit("sms"), F.lit("device_push")))
    rows = e.select("customer").distinct().join(features.usual_device(e), "customer", "left").withColumn("factor", factors)
    return rows.select("customer", "factor", F.when(F.col("factor") == "device_push", F.col("device")).alias("device"))


@query("a12_a13_usage", f"WITH {EVENTS_SQL} SELECT ip, count(DISTINCT customer) AS customers, count(DISTINCT device) AS devices, count(*) AS events FROM ev GROUP BY 1")
def _(spark, sf_dir):
    return events(spark, sf_dir).groupBy("ip").agg(F.countDistinct("customer").alias("customers"), F.countDistinct("device").alias("devices"), F.count("*").alias("events"))


@query("a10_calibration", f"""WITH {EVENTS_SQL}, s AS (SELECT (k + 0.5) / 100.0::DOUBLE AS p, CAST(value > 20 AS INTEGER) AS y FROM ev)
SELECT CAST(floor(p * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM s GROUP BY 1""")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(((F.col("k") + 0.5) / 100.0).alias("p"), (F.col("value") > 20).cast("int").alias("y"))
    return rows.groupBy(F.floor(F.col("p") * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


@query("u_new_customers", f"""WITH {EVENTS_SQL} (SELECT customer FROM ev WHERE kind = 'transaction' UNION SELECT customer FROM ev WHERE kind = 'payee_added') EXCEPT SELECT customer FROM ev WHERE kind = 'mfa_change' AND k % 10 = 0""")
def _(spark, sf_dir):
    e = events(spark, sf_dir)
    some = lambda c: e.where(c).select("customer")
    return some("kind = 'transaction'").union(some("kind = 'payee_added'")).distinct().subtract(some("kind = 'mfa_change' and k % 10 = 0"))


@query("snk4_audit_chain", f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT event_id, k // 10 AS chain, event_id || '|' || kind AS body, row_number() OVER (PARTITION BY k // 10 ORDER BY event_id) AS n FROM ev),
c AS (SELECT chain, n, event_id, '' AS prev_hash, sha256('' || '|' || body) AS row_hash FROM r WHERE n = 1 UNION ALL SELECT r.chain, r.n, r.event_id, c.row_hash, sha256(c.row_hash || '|' || r.body) FROM c JOIN r ON r.chain = c.chain AND r.n = c.n + 1)
SELECT event_id, row_hash, prev_hash FROM c""")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("k") / 10).alias("chain"), F.concat_ws("|", F.col("event_id").cast("string"), "kind").alias("body"))
    return state.chained(rows, "chain", ["event_id"])


@query("a10_model_quality", f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, (k + 0.5) / 100.0::DOUBLE AS p, CAST(value > 20 AS INTEGER) AS y, CASE WHEN kind = 'login' THEN 'login' ELSE 'other' END AS part FROM ev),
b AS (SELECT part, CAST(least(9, floor(p * 10)) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM s GROUP BY 1, 2), ece AS (SELECT part, sum(n * abs(mp - my)) / sum(n) AS ece FROM b GROUP BY 1),
v AS (SELECT part, p, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY part) AS allpos, sum(n - pos) OVER (PARTITION BY part) AS allneg FROM v WINDOW w AS (PARTITION BY part ORDER BY p DESC))
SELECT c.part, CAST(sum(n) AS BIGINT) AS n, CAST(any_value(allpos) AS BIGINT) AS positives, round(sum(pos * (tp / seen)) / any_value(allpos), 6) AS pr_auc, round(sum(pos * (allneg - fp + (n - pos) / 2.0)) / (any_value(allpos) * any_value(allneg)), 6) AS roc_auc, round(any_value(ece.ece), 6) AS ece FROM c JOIN ece USING (part) GROUP BY 1""")
def _(spark, sf_dir):
    part = F.when(F.col("kind") == "login", "login").otherwise("other").alias("part")
    return reports.model_quality(events(spark, sf_dir).select(part, ((F.col("k") + 0.5) / 100.0).alias("p"), (F.col("value") > 20).cast("int").alias("y")), "part")


@query("snk4_audit_links", f"""WITH {EVENTS_SQL}, r AS (SELECT event_id, k // 10 AS chain, sha256(event_id || '|' || kind) AS row_hash FROM ev)
SELECT event_id, row_hash, coalesce(lag(row_hash) OVER (PARTITION BY chain ORDER BY event_id), '') AS prev_hash FROM r""")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.floor(F.col("k") / 10).alias("chain"), F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "kind"), 256).alias("row_hash"))
    prev = F.lag("row_hash").over(features.Window.partitionBy("chain").orderBy("event_id"))
    return rows.select("event_id", "row_hash", F.coalesce(prev, F.lit("")).alias("prev_hash"))
