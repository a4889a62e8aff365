"""Feature-window queries; their SQL states each window as a self-join."""

from __future__ import annotations

from ..operators import features
from ..sources.bridge import EVENTS_SQL, events, ordered
from .registry import query

TX = f"WITH {EVENTS_SQL}, tx AS (SELECT * FROM ev WHERE kind = 'transaction') "
LOGIN = f"WITH {EVENTS_SQL}, lg AS (SELECT * FROM ev WHERE kind = 'login') "
BEFORE = "(b.us, b.event_id) < (a.us, a.event_id)"


def within(span: str) -> str:
    return f"b.us >= a.us - {span}"


MINUTE, HOUR, DAY = "60000000", "3600000000", "86400000000"
IST = "floor(((us + 19800000000) % 86400000000) / 1000000) / 3600.0"

SQL_AMOUNTS = TX + f"""
SELECT a.event_id, round(ln(1 + any_value(a.amount) / 100.0), 6) AS log_amount,
  round(CASE WHEN median(b.amount) > 0 THEN any_value(a.amount) / median(b.amount) ELSE 1.0 END, 6) AS amount_to_median_30d,
  count(b.amount) FILTER (WHERE {within(HOUR)}) AS txn_count_1h,
  CAST(coalesce(sum(b.amount) FILTER (WHERE {within(DAY)}), 0) AS BIGINT) AS txn_sum_24h_paise
FROM tx a LEFT JOIN tx b ON b.customer = a.customer AND {BEFORE} AND {within('30 * ' + DAY)} GROUP BY a.event_id"""

SQL_PAYEES = TX + f"""
, added AS (SELECT a.event_id, max(b.us) AS at FROM tx a JOIN ev b ON b.kind = 'payee_added' AND b.customer = a.customer AND b.payee = a.payee AND {BEFORE} GROUP BY a.event_id),
fan AS (SELECT a.event_id, count(DISTINCT b.customer) AS n, sum(b.amount) AS inbound FROM tx a JOIN tx b ON b.payee = a.payee AND {BEFORE} AND {within(DAY)} GROUP BY a.event_id),
others AS (SELECT a.event_id, count(DISTINCT b.customer) AS n FROM tx a JOIN tx b ON b.payee = a.payee AND b.customer <> a.customer AND {BEFORE} AND {within(DAY)} GROUP BY a.event_id),
outflow AS (SELECT a.event_id, sum(b.amount) AS n FROM tx a JOIN tx b ON b.account = a.payee AND {BEFORE} AND {within(DAY)} GROUP BY a.event_id),
pair AS (SELECT a.event_id, sum(b.amount) AS total, count(*) FILTER (WHERE (b.amount >= 9500000 AND b.amount < 10000000) OR (b.amount >= 19000000 AND b.amount < 20000000) OR (b.amount >= 47500000 AND b.amount < 50000000)) AS near
  FROM tx a JOIN tx b ON b.customer = a.customer AND b.payee = a.payee AND {BEFORE} AND {within(DAY)} GROUP BY a.event_id)
SELECT a.event_id, round(CASE WHEN a.us - added.at <= 7 * {DAY} THEN (a.us - added.at) / {MINUTE}.0 ELSE 10080.0 END, 6) AS minutes_since_payee_added,
  coalesce(a.us - added.at < {DAY}, false) AS payee_is_new, coalesce(others.n, 0) AS payee_fan_in_24h,
  round(CASE WHEN fan.inbound > 0 THEN coalesce(outflow.n, 0) / fan.inbound ELSE 0.0 END, 6) AS payee_passthrough_24h,
  CAST(coalesce(pair.total, 0) AS BIGINT) AS payee_sum_24h_paise,
  coalesce(pair.near, 0) + CAST((a.amount >= 9500000 AND a.amount < 10000000) OR (a.amount >= 19000000 AND a.amount < 20000000) OR (a.amount >= 47500000 AND a.amount < 50000000) AS BIGINT) AS near_limit_count_24h
FROM tx a LEFT JOIN added USING (event_id) LEFT JOIN fan USING (event_id) LEFT JOIN others USING (event_id) LEFT JOIN outflow USING (event_id) LEFT JOIN pair USING (event_id)"""


def km(a: str, b: str) -> str:
    half = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    return f"CASE WHEN ({half}) IS NOT NULL THEN 2 * 6371.0088 * asin(least(1.0, sqrt({half}))) END"


SQL_LOGINS = LOGIN + f"""
, h AS (SELECT a.event_id, count(*) AS n, median({IST.replace('us', 'b.us')}) AS usual FROM lg a JOIN lg b ON b.customer = a.customer AND b.result = 'success' AND {BEFORE} AND {within('30 * ' + DAY)} GROUP BY a.event_id),
f AS (SELECT a.event_id, count(*) AS n FROM lg a JOIN lg b ON b.customer = a.customer AND b.result = 'failure' AND {BEFORE} AND {within(HOUR)} GROUP BY a.event_id),
p AS (SELECT a.event_id, round(b.lat, 2) AS lat, round(b.lon, 2) AS lon, count(*) AS n, min((b.us, b.event_id)) AS first FROM lg a JOIN lg b ON b.customer = a.customer AND b.result = 'success' AND {BEFORE} AND {within('30 * ' + DAY)} GROUP BY 1, 2, 3),
home AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, first) AS r FROM p) WHERE r = 1),
last AS (SELECT a.event_id, arg_max({{'us': b.us, 'lat': b.lat, 'lon': b.lon}}, (b.us, b.event_id)) AS l FROM lg a JOIN lg b ON b.customer = a.customer AND {BEFORE} GROUP BY a.event_id),
lastrow AS (SELECT event_id, l.us AS us, l.lat AS lat, l.lon AS lon FROM last),
x AS (SELECT *, {IST} AS hour FROM lg)
SELECT a.event_id, coalesce(h.n, 0) AS past_logins_30d,
  round(coalesce(least(abs(a.hour - h.usual) % 24, 24 - abs(a.hour - h.usual) % 24), 0.0), 6) AS hour_deviation,
  round(coalesce({km('a', 'home')}, 0.0), 6) AS km_from_home,
  round(coalesce(({km('a', 'lastrow')}) / greatest(1 / 60.0, (a.us - lastrow.us) / {HOUR}.0), 0.0), 6) AS travel_speed_kmh,
  coalesce(f.n, 0) AS failed_logins_1h
FROM x a LEFT JOIN h USING (event_id) LEFT JOIN f USING (event_id) LEFT JOIN home USING (event_id) LEFT JOIN lastrow USING (event_id)"""

SQL_DEVICES = f"""WITH {EVENTS_SQL},
d AS (SELECT a.event_id, max(b.us) AS us FROM ev a JOIN ev b ON b.customer = a.customer AND b.device = a.device AND {BEFORE} GROUP BY a.event_id),
n AS (SELECT a.event_id, max(b.us) AS us FROM ev a JOIN ev b ON b.customer = a.customer AND b.asn = a.asn AND {BEFORE} GROUP BY a.event_id),
fresh AS (SELECT a.*, (d.us IS NULL OR a.us - d.us > 30 * {DAY}) AS device_new, (n.us IS NULL OR a.us - n.us > 30 * {DAY}) AS asn_new FROM ev a LEFT JOIN d USING (event_id) LEFT JOIN n USING (event_id)),
x AS (SELECT a.event_id, max(b.us) FILTER (WHERE b.device_new) AS new_at, max(b.us) FILTER (WHERE b.kind = 'mfa_change') AS mfa_at FROM fresh a JOIN fresh b ON b.customer = a.customer AND {BEFORE} GROUP BY a.event_id)
SELECT a.event_id, device_new AS device_first_seen, asn_new AS asn_first_seen,
  round(CASE WHEN device_new THEN 0.0 WHEN a.us - new_at <= 7 * {DAY} THEN (a.us - new_at) / {MINUTE}.0 ELSE 10080.0 END, 6) AS minutes_since_new_device,
  round(CASE WHEN a.us - mfa_at <= 7 * {DAY} THEN (a.us - mfa_at) / {MINUTE}.0 ELSE 10080.0 END, 6) AS minutes_since_mfa_change
FROM fresh a LEFT JOIN x USING (event_id)"""

SQL_IP = LOGIN + f"""
SELECT a.event_id, count(DISTINCT b.customer) AS ip_failed_customers_1h FROM lg a LEFT JOIN lg b ON b.ip = a.ip AND b.result = 'failure' AND (b.us, b.event_id) <= (a.us, a.event_id) AND {within(HOUR)} GROUP BY a.event_id"""

SQL_CHALLENGES = f"""WITH {EVENTS_SQL}, mc AS (SELECT * FROM ev WHERE kind = 'mfa_challenge')
SELECT a.event_id, count(b.event_id) FILTER (WHERE {BEFORE} AND b.result = 'failed' AND {within('15 * ' + MINUTE)}) AS mfa_fails_15m,
  count(b.event_id) FILTER (WHERE b.method = 'device_push' AND b.result IN ('failed', 'ignored') AND {within('10 * ' + MINUTE)}) AS push_rejects_10m
FROM mc a LEFT JOIN mc b ON b.customer = a.customer AND (b.us, b.event_id) <= (a.us, a.event_id) GROUP BY a.event_id"""

SQL_TRANSFERS = TX + f"""
, n AS (SELECT *, CASE WHEN amount >= 9500000 AND amount < 10000000 THEN 10000000 WHEN amount >= 19000000 AND amount < 20000000 THEN 20000000 WHEN amount >= 47500000 AND amount < 50000000 THEN 50000000 END AS lim FROM tx),
j AS (SELECT a.event_id, a.us AS now, b.us, b.amount, b.lim FROM n a JOIN n b ON b.customer = a.customer AND b.payee = a.payee AND (b.us, b.event_id) <= (a.us, a.event_id) AND {within(DAY)}),
per AS (SELECT event_id, lim, count(*) AS c FROM j WHERE lim IS NOT NULL GROUP BY 1, 2),
best AS (SELECT event_id, arg_min(lim, (-c, lim)) AS lim, max(c) AS c FROM per GROUP BY 1)
SELECT event_id, count(*) AS tw_pair_count_24h, CAST(sum(amount) AS BIGINT) AS tw_pair_sum_24h_paise, count(*) FILTER (WHERE us >= now - {HOUR}) AS tw_pair_count_1h,
  count(j.lim) AS tw_near_limit_count_24h, CAST(coalesce(sum(amount) FILTER (WHERE j.lim IS NOT NULL), 0) AS BIGINT) AS tw_near_limit_sum_24h_paise,
  coalesce(any_value(best.c), 0) AS tw_near_limit_same_limit_max_24h, CAST(coalesce(any_value(best.lim), 0) AS BIGINT) AS tw_near_limit_limit_paise,
  round(CASE WHEN count(j.lim) > 0 THEN count(j.lim) / greatest(1.0, (any_value(now) - min(us) FILTER (WHERE j.lim IS NOT NULL)) / {HOUR}.0) ELSE 0.0 END, 6) AS tw_near_limit_rate_per_h
FROM j LEFT JOIN best USING (event_id) GROUP BY event_id"""

SQL_ACCOUNTS = LOGIN + f"""
, j AS (SELECT a.event_id, a.us AS now, b.us, b.ip, b.device FROM lg a JOIN lg b ON b.account = a.account AND b.result = 'failure' AND (b.us, b.event_id) <= (a.us, a.event_id) AND {within(DAY)}),
hour AS (SELECT event_id, count(*) AS n, count(DISTINCT ip) + count(DISTINCT device) AS sources FROM j WHERE us >= now - {HOUR} GROUP BY 1),
ips AS (SELECT event_id, ip, count(*) AS c FROM j GROUP BY 1, 2),
day AS (SELECT event_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS ips, max(c) AS most FROM ips GROUP BY 1),
dev AS (SELECT a.event_id, count(DISTINCT b.account) AS accounts, count(*) FILTER (WHERE b.result = 'failure') AS failed FROM lg a JOIN lg b ON b.device = a.device AND (b.us, b.event_id) <= (a.us, a.event_id) AND {within(HOUR)} GROUP BY a.event_id)
SELECT a.event_id, coalesce(hour.n, 0) AS acct_fail_1h, coalesce(hour.sources, 0) AS acct_fail_sources_1h, dev.accounts AS dev_accounts_1h, dev.failed AS dev_fail_1h,
  coalesce(day.n, 0) AS acct_fail_24h, coalesce(day.ips, 0) AS acct_fail_ips_24h, coalesce(day.most, 0) AS acct_max_fail_per_ip_24h
FROM lg a LEFT JOIN hour USING (event_id) LEFT JOIN day USING (event_id) LEFT JOIN dev USING (event_id)"""

SQL_GLOBAL = LOGIN + f"""
, m AS (SELECT *, us // {MINUTE} AS minute FROM lg)
SELECT a.event_id, count(b.event_id) FILTER (WHERE b.minute >= a.minute - 9 AND (b.us, b.event_id) <= (a.us, a.event_id)) AS global_fail_10m,
  round(count(b.event_id) FILTER (WHERE b.minute < a.minute - 9 AND b.minute >= a.minute - 1449) / 144.0, 6) AS global_fail_baseline_10m,
  (global_fail_10m >= 2 AND global_fail_10m >= 5 * (count(b.event_id) FILTER (WHERE b.minute < a.minute - 9 AND b.minute >= a.minute - 1449) / 144.0)) AS global_spike
FROM m a LEFT JOIN m b ON b.result = 'failure' AND b.minute >= a.minute - 1449 AND b.minute <= a.minute GROUP BY a.event_id"""

SQL_GLOBAL_DEFAULT = SQL_GLOBAL.replace("global_fail_10m >= 2 AND", "global_fail_10m >= 30 AND")

SQL_USUAL = f"""WITH {EVENTS_SQL}, c AS (SELECT customer, device, count(*) AS n FROM ev GROUP BY 1, 2)
SELECT customer, device, n AS events FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY n DESC, device) AS r FROM c) WHERE r = 1"""

for name, f, sql in (
    ("w1_w3_amount_windows", features.amounts, SQL_AMOUNTS),
    ("w4_w7_payee_windows", features.payees, SQL_PAYEES),
    ("w8_w13_login_history", features.logins, SQL_LOGINS),
    ("w9_w14_device_history", features.devices, SQL_DEVICES),
    ("w15_ip_failures", features.ip_failures, SQL_IP),
    ("w19_challenge_windows", features.challenges, SQL_CHALLENGES),
    ("w20_transfer_windows", features.transfer_windows, SQL_TRANSFERS),
    ("w22_w23_account_failures", features.account_failures, SQL_ACCOUNTS),
    ("w24_global_failures", lambda e: features.global_failures(e, least=2), SQL_GLOBAL),
    ("w31_usual_device", features.usual_device, SQL_USUAL),
):
    query(name, sql)(lambda spark, sf_dir, f=f: f(ordered(events(spark, sf_dir))))
