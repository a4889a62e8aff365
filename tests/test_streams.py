"""Windows and upserts on streams against their batch forms."""

import os
import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnwell.functions.scalars import DAY
from tarnwell.operators import features, graph
from tarnwell.sources.bridge import events, ordered
from tarnwell.streaming import asof, upserts

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put(df, folder, i):
    """One more file, which a stream reads as the i-th."""
    known = set(Path(folder).glob("*.parquet"))
    df.coalesce(1).write.mode("append").parquet(str(folder))
    for f in set(Path(folder).glob("*.parquet")) - known:
        os.utime(f, (1_700_000_000 + 10 * i,) * 2)


@pytest.fixture
def arriving(spark, tmp_path):
    """A month of events of a few customers, some repeated, in four files in shuffled order; the last file's time ends the rest."""
    e = events(spark, "/root/testdata/sf0.001").where("customer in ('cust:0', 'cust:1', 'cust:2', 'cust:3')")
    # a day holds what a month did, so that windows fill
    e = e.withColumn("us", F.col("us") - F.col("us") % 1000 - (F.col("us") % (3 * DAY)) + (F.col("us") % (3 * DAY)) / 3).withColumn("us", F.col("us").cast("long")).withColumn("ts", F.timestamp_micros("us"))
    rows = [r.asDict() for r in e.collect()]
    shuffled = rows + rows[::9]
    random.Random(3).shuffle(shuffled)
    for i in range(4):
        put(spark.createDataFrame(shuffled[i::4], e.schema), tmp_path / "in", i)
    end = dict(rows[0]) | {"us": rows[0]["us"] + 400 * DAY, "event_id": -1, "customer": "cust:end"}
    last = spark.createDataFrame([end | {"kind": kind} for kind in ("transaction", "login")], e.schema).withColumn("ts", F.timestamp_micros("us"))
    put(last, tmp_path / "in", 9)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return e, stream, str(tmp_path)


def drained(spark, df, folder):
    name = "s_" + uuid.uuid4().hex
    run = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    return sorted(tuple(r) for r in spark.table(name).where("event_id >= 0").collect())


def test_windows_on_a_stream_are_those_of_the_batch(spark, arriving):
    e, stream, folder = arriving
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    batch = ordered(e)
    late = "100 days"
    cases = [
        (asof.amounts(stream, late), features.amounts(batch).select("event_id", "txn_count_1h", "txn_sum_24h_paise")),
        (asof.failed_logins(stream, late), features.logins(batch).select("event_id", "failed_logins_1h")),
        (asof.transfer_windows(stream, late=late), features.transfer_windows(batch)),
    ]
    for got, want in cases:
        columns = got.columns
        rows = drained(spark, got, folder)
        assert rows == sorted(tuple(r) for r in want.select(*columns).collect())
        assert len({r[1:] for r in rows}) > 2


def test_late_events_are_dropped(spark, tmp_path):
    """Those below the watermark of the batch before theirs, up to which events have been released."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = "event_id long, us long, kind string, customer string, amount long, ts timestamp"
    hour = 3_600_000_000
    for n, rows in enumerate(([(1, 100 * hour)], [(2, 100 * hour + 1000)], [(3, 200 * hour)], [(5, 201 * hour)], [(4, 99 * hour)], [(-1, 900 * hour)])):
        df = spark.createDataFrame([(i, us, "transaction", "c", 5) for i, us in rows], "event_id long, us long, kind string, customer string, amount long").withColumn("ts", F.timestamp_micros("us"))
        put(df, tmp_path / "in", n)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert drained(spark, asof.amounts(stream, "10 hours"), str(tmp_path)) == [(1, 0, 0), (2, 1, 5), (3, 0, 0), (5, 1, 5)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    e = events(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "edges")
    shown = lambda df: sorted((tuple(r) for r in df.select("src", "dst", "edge_type", "confidence", "first_seen", "last_seen", "count", "ids").collect()), key=str)
    want = shown(graph.merged(graph.observations(e)))
    parts = [e.where(F.col("event_id") % 3 == i) for i in range(3)]
    for i in (0, 1, 1, 0, 2, 1):
        upserts.upsert(parts[i], i, path)
    assert shown(upserts.edges(spark, path)) == want
    upserts.compact(spark, path, 1)
    upserts.upsert(parts[0], 0, path)  # replayed after its base: left alone
    upserts.upsert(parts[2], 2, path)
    assert shown(upserts.edges(spark, path)) == want
    assert upserts.edges(spark, str(tmp_path / "none")).collect() == []


def test_a_stream_of_events_keeps_its_edges_over_a_restart(spark, tmp_path):
    e = events(spark, "/root/testdata/sf0.001")
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "edges"), str(tmp_path / "cp")
    for i in range(2):
        e.where(F.col("event_id") % 2 == i).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(e.schema).parquet(source)
        assert upserts.start(stream, path, checkpoint, availableNow=True).awaitTermination(120)
    got, want = (sorted((tuple(r) for r in df.select("src", "dst", "edge_type", "count", "ids").collect()), key=str) for df in (upserts.edges(spark, path), graph.merged(graph.observations(e))))
    assert got == want
