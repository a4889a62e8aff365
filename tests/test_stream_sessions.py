"""Sessions on a stream: what was told last is the batch's, corrections come when they must, and state goes."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import state
from tarnwell.plans.detector_queries import session_events
from tarnwell.sources.bridge import ordered
from tarnwell.streaming import sessions

from .test_streams import STORE, put

HOUR = 3_600_000_000


def told(spark, folder, late, ttl=24 * HOUR):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = spark.read.parquet(f"{folder}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = sessions.sessions(stream, ttl, late).writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
    assert run.awaitTermination(240)
    return spark.read.parquet(f"{folder}/out")


def arrive(spark, folder, files):
    schema = "event_id long, us long, " + ", ".join(f"{f} string" for f in state.Session.fields) + ", session string"
    for n, rows in enumerate(files):
        put(spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("us")), folder / "in", n)


def event(i, hours, asn, device, session="s"):
    return (i, int(hours * HOUR), asn, "mobile", device, "android", None, "cust:1", session)


@pytest.mark.parametrize("ttl", [24 * HOUR, 300 * HOUR])
def test_what_was_told_last_is_the_batch(spark, tmp_path, ttl):
    """Events of all times in each of four files, some of them twice, and some without a session."""
    e = session_events(spark, "/root/testdata/sf0.001").withColumn("ts", F.timestamp_micros("us"))
    for i in range(4):
        part = e.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i)
        put(part.unionByName(e.where("event_id % 11 = 0")).unionByName(part.limit(3).withColumn("session", F.lit(None).cast("string"))), tmp_path / "in", i)
    rows = told(spark, tmp_path, "400 days", ttl)
    last = sessions.latest(rows).collect()
    want = {r["event_id"]: tuple(r)[1:] for r in state.sessions(ordered(e.where("session is not null")), ttl).collect()}
    assert {r["event_id"]: (r["session_seen"], r["session_change_mask"], r["session_change"]) for r in last} == want
    assert len(last) == len(want) and any(r["corrections"] for r in last) and any(not r["corrections"] for r in last)
    revisions = {}
    for r in rows.collect():
        revisions.setdefault(r["event_id"], []).append(r["revision"])
    assert all(sorted(v) == list(range(len(v))) for v in revisions.values())


def test_a_late_event_corrects_those_after_it(spark, tmp_path):
    """Told first: 2 opens, 3 changes net and device. Then 1 comes, from the net and device of 3: now 2 is the change."""
    arrive(spark, tmp_path, [[event(2, 2, "AS1", "d1"), event(3, 3, "AS2", "d2")], [event(1, 1, "AS2", "d2")]])
    rows = told(spark, tmp_path, "10 hours")
    got = sorted((r["event_id"], r["revision"], r["session_seen"], r["session_change_mask"], r["session_change"]) for r in rows.collect())
    assert got == [(1, 0, False, 0, False), (2, 0, False, 0, False), (2, 1, True, 5, True), (3, 0, True, 5, True), (3, 1, True, 0, False)]


def test_events_below_the_watermark_are_dropped_and_idle_sessions_go(spark, tmp_path):
    """4 comes below the watermark; 6 opens the session anew, as its time to live is over and its state is gone."""
    arrive(spark, tmp_path, [[event(1, 1, "AS1", "d1")], [event(2, 30, "AS1", "d1", "other")], [event(3, 31, "AS1", "d1", "other")], [event(4, 2, "AS2", "d2")], [event(5, 90, "AS2", "d2", "other")], [event(6, 91, "AS2", "d2")], [event(7, 92, "AS1", "d1")]])
    rows = told(spark, tmp_path, "2 hours")
    got = sorted((r["event_id"], r["revision"], r["session_seen"], r["session_change_mask"]) for r in rows.where("session = 's'").collect())
    assert got == [(1, 0, False, 0), (6, 0, False, 0), (7, 0, True, 5)]


def test_settled_context_serves_events_above_the_watermark(spark, tmp_path):
    """2 is settled before 3 comes: the state has its context, no longer its event."""
    arrive(spark, tmp_path, [[event(1, 1, "AS1", "d1")], [event(9, 8, "AS1", "d1", "other")], [event(2, 7, "AS2", "d2")], [event(10, 16, "AS1", "d1", "other")], [event(11, 16.5, "AS1", "d1", "other")], [event(3, 15.5, "AS2", "d2")]])
    rows = told(spark, tmp_path, "2 hours")
    got = sorted(tuple(r)[1:] for r in rows.where("session = 's'").collect())
    assert got == [(1, 0, False, 0, False), (2, 0, True, 5, True), (3, 0, True, 5, False)]
