"""Counts and sums over trailing spans, without a frame of rows, against plain Python."""

import random

from pyspark.sql import functions as F

from tarnwell.functions.scalars import DAY, HOUR
from tarnwell.operators import features, graph
from tarnwell.sources.bridge import ordered

T = 1_704_067_200_000_000


def drawn(seed, n=400):
    rnd = random.Random(seed)
    kinds, step = ("login", "transaction", "payee_added"), HOUR // 4
    rows = []
    for i in range(n):
        us = T + rnd.randrange(160) * step + rnd.choice((0, 0, 1))
        who = rnd.choice((None, "c1", "c2", "c3", "c4", "c5"))
        rows.append((i, us, rnd.choice(kinds), who, rnd.choice(("a1", "a2", "a3")), rnd.choice(("d1", "d2", "d3", None)), rnd.choice(("ip1", "ip2", None)), rnd.choice(("success", "failure", None)), rnd.choice(("a1", "a2", "a9")), rnd.choice((None, 5, 70))))
    return rows


SCHEMA = "event_id long, us long, kind string, customer string, account string, device string, ip string, result string, payee string, amount long"


def test_distinct_values_of_a_span(spark):
    rows = drawn(1)
    events = ordered(spark.createDataFrame(rows, SCHEMA))
    logins = sorted((r for r in rows if r[2] == "login"), key=lambda r: (r[1], r[0]))

    def count(i, span, column, result):
        at = logins[i]
        return len({b[column] for b in logins[: i + 1] if b[6] == at[6] and b[1] >= at[1] - span and b[column] is not None and (result is None or b[7] == result)})

    found = {r["event_id"]: r["ip_failed_customers_1h"] for r in features.ip_failures(events).collect()}
    assert found == {r[0]: count(i, HOUR, 3, "failure") for i, r in enumerate(logins)}
    shared = {r["event_id"]: (r["ip_devices"], r["ip_accounts"]) for r in graph.shared_ips(events).collect()}
    assert shared == {r[0]: (count(i, DAY, 5, None), count(i, DAY, 4, "success")) for i, r in enumerate(logins)}


def test_payee_windows_without_frames(spark):
    rows = drawn(2)
    sent = sorted((r for r in rows if r[2] == "transaction"), key=lambda r: (r[1], r[0]))
    expected = {}
    for i, a in enumerate(sent):
        before = [b for b in sent[:i] if b[1] >= a[1] - DAY]
        into, out = (sum(b[9] or 0 for b in before if b[c] == a[8]) for c in (8, 4))
        expected[a[0]] = (len({b[3] for b in before if b[8] == a[8] and b[3] is not None} - {a[3]}), round(out / into, 9) if into else 0.0)
    found = features.payees(ordered(spark.createDataFrame(rows, SCHEMA)))
    assert {r["event_id"]: (r["payee_fan_in_24h"], round(r["payee_passthrough_24h"], 9)) for r in found.collect()} == expected


def test_no_set_is_collected_over_a_frame(spark):
    events = ordered(spark.createDataFrame(drawn(3, 20), SCHEMA)).withColumn("staff", F.col("ip"))
    for found in (features.ip_failures(events), graph.shared_ips(events), features.payees(events), features.staff_reads(events)):
        assert "collect_set" not in found._jdf.queryExecution().toString()


def test_cases_of_large_numbers_have_a_status(spark):
    from tarnwell.plans.analytics_queries import status

    row = spark.range(1).select(F.lit("case:9000000013").alias("case_id")).select(status("case_id").alias("s")).first()
    assert row["s"] == "INVESTIGATING"


def test_standing_of_a_busy_account_without_frames(spark):
    from tarnwell.operators import asof

    rnd, minute = random.Random(5), 60_000_000
    rows = []
    for i in range(500):
        us, a, b = T + rnd.randrange(6 * 24 * 60) * minute, *rnd.sample(("acct:1", "acct:2", "acct:3", "acct:4"), 2)
        rows.append((i, us, "transaction", "cust:1", a, None, None, None, b, 10))
    events = ordered(spark.createDataFrame(rows, SCHEMA)).cache()
    asked = events.select(F.col("event_id").alias("ask"), F.col("payee").alias("account"), "o", "us")
    rows.sort(key=lambda r: (r[1], r[0]))
    expected = {}
    for i, a in enumerate(rows):
        gaps = []
        for j, b in enumerate(rows[: i + 1]):
            came = [c[1] for c in rows[:j] if c[8] == a[8]]
            if b[4] == a[8] and came and b[1] >= a[1] - DAY:
                gaps.append((b[1] - max(came)) / minute)
        expected[a[0]] = min(gaps, default=None)
    found = asof.standing(asof.sightings(events), asked)
    assert {r["ask"]: r["pass_through_min"] for r in found.collect()} == expected
    assert "RangeFrame, -" not in asof.with_trailing(asked, "account", DAY, sums={"n": F.lit(1)})._jdf.queryExecution().toString()
