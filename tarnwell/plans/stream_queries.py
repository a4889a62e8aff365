"""Queries that read the events as a stream of files and give what the batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bridge import events
from ..sources.stable import shared_folder
from ..streaming import asof, sessions, upserts
from . import feature_queries as fq
from .detector_queries import SQL_SESSIONS, session_events
from .graph_queries import OBS
from .registry import query

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arriving(spark: SparkSession, e: DataFrame, files: int = 3, last: DataFrame | None = None) -> tuple[DataFrame, str]:
    """``e`` written as files, each with events of the whole time, and read as a stream; and the folder. ``last`` comes
    in a file after all others: the stream takes files as they were written."""
    folder = shared_folder(spark)
    e.repartition(files, F.col("event_id")).write.parquet(f"{folder}/in")
    if last is not None:
        last.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


@query("st4_stream_amounts", f"SELECT event_id, txn_count_1h, txn_sum_24h_paise FROM ({fq.SQL_AMOUNTS})")
def _(spark, sf_dir):
    """The count of an hour and the sum of a day before each payment, on a stream whose events come in any order."""
    e = events(spark, sf_dir).withColumn("ts", F.timestamp_micros("us"))
    # events wait for the watermark, so a last one of another customer ends the stream; coming earlier, it would make the others late
    last = e.where("kind = 'transaction'").limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "customer": F.lit("cust:end"), "us": F.col("us") + 400 * 86_400_000_000})
    stream, folder = arriving(spark, e, last=last.withColumn("ts", F.timestamp_micros("us")))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run = asof.amounts(stream, late="40 days").writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.parquet(f"{folder}/out").where("event_id >= 0")


@query("st11_stream_edges", OBS + """ SELECT src, dst, edge_type, CAST(max(confidence) AS DOUBLE) AS confidence, min(us) AS first_seen, max(us) AS last_seen, count(*) AS count,
  array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 50), ',') AS ids FROM obs GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    """Edges that a stream of events keeps up to date, each batch once, folded into a base half way."""
    stream, folder = arriving(spark, events(spark, sf_dir))
    upserts.start(stream, f"{folder}/edges", f"{folder}/state", availableNow=True).awaitTermination()
    upserts.compact(spark, f"{folder}/edges", 0)
    return upserts.edges(spark, f"{folder}/edges").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("st6_stream_sessions", SQL_SESSIONS)
def _(spark, sf_dir):
    """Each event's session verdict as a stream told it last: files come in any order, so verdicts are told and corrected."""
    stream, folder = arriving(spark, session_events(spark, sf_dir).withColumn("ts", F.timestamp_micros("us")))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run = sessions.sessions(stream, late="400 days").writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return sessions.latest(spark.read.parquet(f"{folder}/out")).drop("session", "corrections")
