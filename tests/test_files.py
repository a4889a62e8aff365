"""Readers against files with good and bad lines, and streams of them."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import enrich, state
from tarnwell.sources import files
from tarnwell.streaming import folds


def event(i, **more):
    return {"event_id": f"evt_{i:08d}", "event_type": "login", "source": "web", "occurred_at": "2026-10-09T00:39:00.25+05:30", "context": {"ip": "10.0.0.1", "asn": "AS1"}, "subject": {"customer_id": "c1"}, "payload": {"result": "success"}, **more}


def written(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_events_and_their_quarantine(spark, tmp_path):
    path = written(tmp_path / "e.jsonl", [event(1), "", "not json", event(2, event_type="dance"), event(3, occurred_at="2026-10-09T00:39:00"), event(4, occurred_at="2026-10-08T19:09:00Z"), {**event(5), "event_id": "short"}, {"event_id": "evt_00000009"}])
    good, bad = files.read_events(spark, path)
    rows = {r["event_id"]: r for r in good.withColumn("us", F.unix_micros("occurred_at")).collect()}
    assert set(rows) == {"evt_00000001", "evt_00000004"}
    assert rows["evt_00000001"]["us"] - rows["evt_00000004"]["us"] == 250_000
    assert rows["evt_00000001"]["ip"] == "10.0.0.1" and json.loads(rows["evt_00000001"]["payload"]) == {"result": "success"}
    errors = [r["errors"] for r in bad.collect()]
    assert len(errors) == 5 and all(e in errors for e in (["occurred_at"], ["event_type"], ["event_id"], ["event_type", "occurred_at", "payload"]))
    assert "e.jsonl" in bad.first()["file"]


def test_alert_lines(spark, tmp_path):
    alert = {"timestamp": "2026-10-09T00:39:00.123456+0530", "event_type": "alert", "src_ip": "1.2.3.4", "dest_ip": "5.6.7.8", "dest_port": 443, "alert": {"signature_id": 9, "signature": "s", "category": "c", "severity": 7}}
    no_port = {k: v for k, v in alert.items() if k != "dest_port"}
    path = written(tmp_path / "eve.json", [alert, {**alert, "event_type": "flow"}, no_port, "{broken", {**alert, "timestamp": "yesterday"}])
    good, bad = files.read_alerts(spark, path)
    row = good.withColumn("us", F.unix_micros("occurred_at")).collect()
    assert [(r["severity"], r["dest_port"], r["us"] % 1_000_000) for r in row] == [(3, 443, 123456)]
    assert {("dest_port",), ("occurred_at",)} <= {tuple(r["errors"]) for r in bad.collect()}
    assert bad.count() == 3


def test_networks_feed_the_range_join(spark, tmp_path):
    path = written(tmp_path / "n.csv", ["# demo", "cidr,network_type,asn,org,ip_timezone,confidence", "10.0.0.0/8,mobile,as0001 Co,Org,Asia/Kolkata,", "10.1.2.3/24,vpn,AS2,Org,,0.5", "10.9.9.9,tor,,,,1", "300.1.1.1/8,vpn,,,,", "10.0.0.0/40,vpn,,,,", "1.0.0.0/8,weird,,,,", "2.0.0.0/8,vpn,,,,7"])
    good, bad = files.networks(files.lines(spark, path))
    assert sorted(r["errors"][0] for r in bad.collect()) == ["cidr", "cidr", "confidence", "network_type"]
    rows = spark.createDataFrame([(1, "10.1.2.200"), (2, "10.1.3.1"), (3, "10.9.9.9"), (4, "11.0.0.1"), (5, None)], "event_id long, ip string")
    found = enrich.range_join(rows.withColumn("ip_number", files.ipv4(F.col("ip"))), good)
    assert {r["event_id"]: (r["network_type"], r["net_asn"], r["confidence"]) for r in found.collect()} == {1: ("vpn", "AS2", 0.5), 2: ("mobile", "AS1", 0.9), 3: ("tor", None, 1.0), 4: (None, None, None), 5: (None, None, None)}
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_ranges_lists_and_rules(spark, tmp_path):
    raw = files.lines(spark, written(tmp_path / "r.csv", ['"16777216","16777471","VPN"', '"a","b","VPN"', '"5","9","-"', '"4294967296","4294967300","TOR"', '"7","8","tor"']))
    assert sorted(map(tuple, files.proxy_ranges(raw, {"VPN": "vpn", "TOR": "tor"}).collect())) == [(7, 8, "tor"), (16777216, 16777471, "vpn")]
    raw = files.lines(spark, written(tmp_path / "c.txt", ["# carriers", "10.1.2.77/24 # one", "10.2.0.1", "nonsense"]))
    assert sorted(map(tuple, files.network_list(raw).collect())) == [(167838208, 167838463), (167903233, 167903233)]
    (tmp_path / "rules.json").write_text(json.dumps([{"rule": "A", "p": 0.1, "stage": "S", "thresholds": {"least": 3}}]))
    assert files.rule_configs(spark, str(tmp_path / "rules.json")).first()["thresholds"] == {"least": 3.0}
    (tmp_path / "bad.json").write_text(json.dumps([{"rule": "A", "p": 7}]))
    with pytest.raises(Exception, match="no id or p"):
        files.rule_configs(spark, str(tmp_path / "bad.json")).collect()


def test_operator_names_and_locations(spark):
    names = [("Acme VPN Cloud", "vpn"), ("Hetzner Online", "hosting"), ("Jio", "mobile"), ("Some School", None), (None, None)]
    df = spark.createDataFrame(names, "org string, kind string").withColumn("got", enrich.classify_org(F.col("org")))
    assert all(r["got"] == r["kind"] for r in df.collect())
    geo = [("vpn", 0.9, 0.3), ("tor", 0.9, 0.2), ("mobile", 0.1, 1.0), ("unknown", 0.2, 0.7), ("unknown", 0.5, 1.0), (None, None, 1.0)]
    df = spark.createDataFrame(geo, "t string, c double, f double").withColumn("got", enrich.geo_confidence(F.col("t"), F.col("c")))
    assert all(r["got"] == r["f"] for r in df.collect())


def run(df, name, path):
    q = df.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).queryName(name).start()
    assert q.awaitTermination(240)


def test_a_restarted_stream_goes_on_where_it_stopped(spark, tmp_path):
    """New files after a restart; repeats of events that were read before are dropped by the state it kept."""
    (tmp_path / "in").mkdir()

    def stream():
        good, _ = files.event_lines(files.event_stream(spark, str(tmp_path / "in"), 1))
        return folds.deduplicated(good.withColumn("ts", F.col("occurred_at")).select("event_id", "ts"))

    written(tmp_path / "in" / "a.jsonl", [event(1), event(2), "bad line", event(2)])
    run(stream(), "first_" + uuid.uuid4().hex, tmp_path)
    written(tmp_path / "in" / "b.jsonl", [event(2), event(3)])
    run(stream(), "second_" + uuid.uuid4().hex, tmp_path)
    got = sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["evt_00000001", "evt_00000002", "evt_00000003"]


def test_minutes_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(i, f"acct:{i % 3}", "login", "failure" if i % 2 else "success", f"2026-01-01 00:{i % 4:02d}:{i:02d}") for i in range(40)] + [(99, "acct:9", "login", "failure", "2026-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "event_id long, account string, kind string, result string, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "x"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "x"))
    run(folds.failures_by_minute(stream).select(F.col("window.start").alias("start"), "n", "accounts"), "minutes_" + uuid.uuid4().hex, tmp_path)
    got = {(r["start"], r["n"], r["accounts"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = df.where("result = 'failure'").groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("account").alias("accounts")).select("w.start", "n", "accounts")
    assert got == {tuple(r) for r in whole.where("start < '2026-01-01 00:50:00'").collect()}


def test_a_changed_audit_row_breaks_its_chain(spark):
    rows = spark.createDataFrame([(i, i % 2, f"body {i}") for i in range(12)], "event_id long, chain long, body string")
    log = state.chained(rows, "chain", ["event_id"]).join(rows, "event_id")
    assert state.broken(log, "chain", ["event_id"]).count() == 0
    forged = log.withColumn("body", F.when(F.col("event_id") == 4, "forged").otherwise(F.col("body")))
    assert [r["event_id"] for r in state.broken(forged, "chain", ["event_id"]).collect()] == [4]
    assert [r["event_id"] for r in state.broken(log.where("event_id <> 5"), "chain", ["event_id"]).collect()] == [7]


def test_a_session_that_moves_to_an_anonymiser_is_told_apart(spark):
    def one(i, asn, kind, device):
        return (i, i, "s", asn, kind, device, "android", None, "c")
    rows = [one(0, "AS1", "mobile", "d1"), one(1, "AS2", "vpn", "d2"), one(2, "AS1", "mobile", "d2")]
    df = spark.createDataFrame(rows, "event_id long, us long, session string, asn string, network_type string, device string, platform string, gpu string, customer string").withColumn("o", F.col("us"))
    got = {r["event_id"]: r["session_change_mask"] for r in state.sessions(df).collect()}
    assert got == {0: 0, 1: 1 | 2 | 4 | 64, 2: 4}
