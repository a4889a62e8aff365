"""The event that ends a stream lies in a file written after all others."""

import os

from pyspark.sql import functions as F

from tarnwell.plans.stream_queries import arriving


def test_the_last_event_comes_last(spark):
    rows = spark.range(50).select(F.col("id").alias("event_id"))
    _, folder = arriving(spark, rows, last=spark.range(1).select(F.lit(-1).cast("long").alias("event_id")))
    place = folder.removeprefix("file:") + "/in"
    files = sorted((os.stat(f"{place}/{n}").st_mtime_ns, f"{place}/{n}") for n in os.listdir(place) if n.endswith(".parquet"))
    held = [{r[0] for r in spark.read.parquet(f).collect()} for _, f in files]
    assert held[-1] == {-1} and set().union(*held[:-1]) == set(range(50))
