"""Folds, tokens and fusion against plain Python."""

import base64
import hashlib
import hmac
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import scalars
from tarnwell.operators import enrich, fusion, policy, state
from tarnwell.sources import files
from tarnwell.streaming import folds


def test_tokens_match_hmac(spark):
    key, values = b"k" * 32, [" ab c9", "X", "zoë 1", ""]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for kind, norm in (("cust", lambda v: v.strip(" ").upper().replace(" ", "")), ("email", lambda v: v.strip(" ").lower()), ("dev", lambda v: v.strip(" "))):
        got = [r[0] for r in df.select(scalars.token(kind, F.col("v"), key)).collect()]
        digest = [hmac.new(key, f"{kind}:{norm(v)}".encode(), hashlib.sha256).digest() for v in values]
        assert got == [f"{kind}:" + base64.b32encode(d).decode().lower()[:16] for d in digest]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.sigmoid(F.lit(-800.0)).alias("low"), scalars.sigmoid(F.lit(0.0)).alias("mid"),
        scalars.circular_hours(F.lit(23.0), F.lit(1.0)).alias("hours"),
        scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("km"),
        scalars.near_limit(F.lit(9_500_000), (10_000_000,)).alias("near"), scalars.near_limit(F.lit(10_000_000), (10_000_000,)).alias("at"),
        scalars.band(F.lit(0.8)).alias("band"), enrich.asn(F.lit("as0064500 Co")).alias("asn"), enrich.platform(F.lit("Mozilla (Linux; Android 14)")).alias("ua"),
    ).first()
    assert row["low"] == 0.0 and row["mid"] == 0.5 and row["hours"] == 2.0
    assert abs(row["km"] - math.pi * 6371.0088) < 1e-6
    assert row["near"] == 10_000_000 and row["at"] is None and row["band"] == "CRITICAL"
    assert row["asn"] == "AS64500" and row["ua"] == "ua:android"


def test_range_join_takes_the_most_specific(spark):
    ranges = enrich.network_table(spark, (("10.0.0.0/8", "mobile", "AS1", "UTC", 0.5), ("10.1.2.0/24", "vpn", "AS2", "UTC", 0.9)))
    rows = spark.createDataFrame([(1, "10.1.2.3"), (2, "10.9.9.9"), (3, "11.0.0.1"), (4, "bad")], "event_id long, ip string")
    found = enrich.range_join(rows.withColumn("ip_number", files.ipv4(F.col("ip"))), ranges)
    assert {r["event_id"]: r["network_type"] for r in found.collect()} == {1: "vpn", 2: "mobile", 3: None, 4: None}


def golden(evidence, base=0.01):
    """Fuse one list of items the plain way."""
    logit = lambda p: math.log(p / (1 - p))
    ell = [(e["reliability"] * min(3.0, max(-2.0, logit(e["p"]) - logit(base))), e["family"]) for e in evidence]
    total = logit(base)
    for family in {f for _, f in ell}:
        own = sorted((x for x, f in ell if f == family), reverse=True)
        total += own[0] + 0.5 * sum(own[1:])
    return total


def random_evidence(n, seed):
    rnd, out = random.Random(seed), []
    for i in range(n):
        detector = rnd.choice(list(fusion.FAMILY))
        out.append({"evidence_id": i, "case_id": f"c{i % 3}", "us": 40_000_000_000 * i, "customer": "x", "detector": detector, "family": fusion.FAMILY[detector],
                    "stage": "S0_RECON", "p": rnd.choice([0.003, 0.02, 0.08, 0.3, 0.9]), "reliability": 0.7, "reasons": ["R"], "amount": None})
    return out


SCHEMA = "evidence_id long, case_id string, us long, customer string, detector string, family string, stage string, p double, reliability double, reasons array<string>, amount long"


def test_every_prefix_is_fused(spark):
    items = random_evidence(45, 5)
    points = fusion.timeline(spark.createDataFrame([tuple(e.values()) for e in items], SCHEMA)).collect()
    for r in points:
        prefix = [e for e in items if e["case_id"] == r["case_id"] and e["evidence_id"] <= r["evidence_id"]]
        assert r["log_odds"] == pytest.approx(golden(prefix), abs=1e-9)
    assert {r["evidence_id"] for r in points} == set(range(45))


def test_policy_escalates_late_evidence_once(spark):
    rows = [(f"e{i}", i) for i in range(4)]
    points = spark.createDataFrame(
        [("c", 1, 1, "txn", "S6_MONETIZATION", ["R"], 1.0, 0.6, 10, "HIGH"), ("c", 2, 2, "auth", "S2_CONTROL_TAKEOVER", ["R"], 1.0, 0.6, None, "HIGH"), ("c", 3, 3, "auth", "S2_CONTROL_TAKEOVER", ["R"], 1.0, 0.6, None, "HIGH")],
        "case_id string, evidence_id long, us long, detector string, stage string, reasons array<string>, weight double, p_attack double, amount long, band string",
    ).withColumns({"patterns": F.array().cast("array<string>"), "floors": F.array().cast("array<string>")})
    got = {r["evidence_id"]: (r["rule"], r["payment_state"]) for r in policy.decisions(points).collect()}
    assert got == {1: ("high", "held"), 2: ("late_evidence_block", "blocked"), 3: ("high", "blocked")}
    assert rows


def flags(rows, span=state.HOUR):
    at, out = {}, {}
    for event_id, key, us, hit in sorted(rows, key=lambda r: (r[2], r[0])):
        last = at.get(key)
        out[event_id] = (last is not None and us - last < span, hit and (last is None or us - last >= span))
        if out[event_id][1]:
            at[key] = us
    return out


def test_flags_batch_and_stream_agree(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, f"ip:{rnd.randrange(4)}", 10**15 + i * 400_000_000, rnd.random() < 0.4) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, ip string, us long, hit boolean").withColumns({"o": F.col("us") * 1024, "ts": F.timestamp_micros("us")})
    batch = {r["event_id"]: (r["flagged"], r["raised"]) for r in state.rearming_flags(df, "ip", "hit").collect()}
    assert batch == flags(rows)
    for part in (0, 1):
        df.where(f"event_id div 60 = {part}").drop("o").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = "flags_" + uuid.uuid4().hex
    stream = spark.readStream.schema(df.drop("o").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    run = folds.rearming_flags(stream, "ip", "hit").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = {r["event_id"]: (r["flagged"], r["raised"]) for r in spark.table(name).collect()}
    assert got == batch


def test_session_reports_each_changed_context_once(spark):
    def event(i, asn, device):
        return (i, i, "s", asn, "mobile", device, "android", None, "c")

    rows = [event(0, "AS1", "d1"), event(1, "AS2", "d1"), event(2, "AS2", "d2"), event(3, "AS2", "d2"), event(4 + 30 * state.HOUR, "AS2", "d2")]
    df = spark.createDataFrame(rows, "event_id long, us long, session string, asn string, network_type string, device string, platform string, gpu string, customer string").withColumn("o", F.col("us"))
    got = {r["event_id"]: tuple(r)[1:] for r in state.sessions(df).collect()}
    assert got[0] == (False, 0, False) and got[1] == (True, 1, False) and got[2] == (True, 5, True) and got[3] == (True, 5, False)
    assert got[rows[-1][0]] == (False, 0, False)


def test_unknown_zones_are_compared_by_name(spark):
    rows = [("Asia/Kolkata", "Asia/Colombo", False), ("Asia/Kolkata", "Europe/Berlin", True), ("Mars/Base", "mars/base ", False), ("Mars/Base", "Europe/Berlin", True), (None, "Mars/Base", False), ("", "Europe/Berlin", False), ("UTC", "Asia/Kolkata", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select("want", enrich.zone_mismatch(F.lit(1_705_276_800_000_000), F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_addresses_beyond_a_byte_are_none(spark):
    df = spark.createDataFrame([("1.2.3.4",), ("999.1.1.1",), ("1.2.3",), (None,)], "ip string")
    assert [r[0] for r in df.select(files.ipv4(F.col("ip"))).collect()] == [16_909_060, None, None, None]


def test_rows_without_a_key_share_no_state(spark):
    rows = [(1, 10, None), (2, 11, None), (3, 12, "a"), (4, 13, "a"), (5, 14, None)]
    df = spark.createDataFrame(rows, "event_id long, us long, ip string").withColumns({"o": F.col("us"), "hit": F.lit(True)})
    got = {r["event_id"]: (r["flagged"], r["raised"]) for r in state.rearming_flags(df, "ip", "hit").collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, True), 4: (True, False), 5: (False, True)}
