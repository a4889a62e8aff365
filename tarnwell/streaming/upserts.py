"""Edges kept up to date by a stream, each batch exactly once.

A batch's observations are merged and written as the folder of its batch id, which a replayed batch writes
again with the same rows: the folders are the ledger. Readers merge them; :func:`compact` folds those up to
a batch into one base. A base counts once its _SUCCESS is there, and from then on the batches that it holds
no longer do, so readers see each batch once whenever they come. All in a folder that the cluster shares.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import MOST_IDS, observations

EDGE = "src string, dst string, edge_type string, confidence double, first_seen long, last_seen long, count long, ids array<struct<us: long, event_id: long>>"


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The ids of the bases and batches that are whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    if fs.exists(at):
        for status in fs.listStatus(at):
            folder = status.getPath()
            if (m := re.fullmatch(r"(base|batch)-(\d+)", folder.getName())) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
                found[m[1]].append(int(m[2]))
    return found


def _parts(spark: SparkSession, path: str, up_to: int | None = None) -> DataFrame:
    found = _folders(spark, path)
    base = max(found["base"], default=None)
    batches = [i for i in found["batch"] if (base is None or i > base) and (up_to is None or i <= up_to)]
    folders = [f"{path}/batch-{i}" for i in sorted(batches)] + ([f"{path}/base-{base}"] if base is not None else [])
    return spark.read.schema(EDGE).parquet(*folders) if folders else spark.createDataFrame([], EDGE)


def _folded(rows: DataFrame) -> DataFrame:
    """Rows of one edge as one; of its events the first ``MOST_IDS`` stay."""
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, MOST_IDS)
    return rows.groupBy("src", "dst", "edge_type").agg(F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count"), ids.alias("ids"))


def upsert(events: DataFrame, batch_id: int, path: str) -> None:
    """Write the edges that a batch of events shows; a batch that a base holds already is left alone."""
    spark = events.sparkSession
    if batch_id <= max(_folders(spark, path)["base"], default=-1):
        return
    place = F.row_number().over(Window.partitionBy("src", "dst", "edge_type").orderBy("us", "event_id"))
    first = F.when(F.col("place") <= MOST_IDS, F.struct("us", "event_id"))
    own = observations(events).withColumn("place", place).groupBy("src", "dst", "edge_type").agg(
        F.max("confidence").alias("confidence"), F.min("us").alias("first_seen"), F.max("us").alias("last_seen"), F.count("*").alias("count"), F.array_sort(F.collect_list(first)).alias("ids")
    )
    own.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """The edges of all whole batches, as :func:`tarnwell.operators.graph.merged` gives them for all events at once."""
    return _folded(_parts(spark, path)).withColumn("ids", F.transform("ids", lambda x: x["event_id"]))


def compact(spark: SparkSession, path: str, up_to: int) -> None:
    """Fold the batches up to this one into a base."""
    _folded(_parts(spark, path, up_to)).write.mode("overwrite").parquet(f"{path}/base-{up_to}")


def start(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the edges of a stream of events in ``path``; the checkpoint says which batch comes next."""
    return events.writeStream.foreachBatch(lambda batch, i: upsert(batch, i, path)).option("checkpointLocation", checkpoint).trigger(**trigger).start()
