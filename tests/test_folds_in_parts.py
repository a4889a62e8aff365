"""Folds over parts of a key's events give what they give over the whole key, and no key is gathered in one part."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import graph, state

from .test_engine import flags


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_state_goes_from_part_to_part(spark, small_parts):
    rnd = random.Random(4)
    rows = [(i, f"ip:{rnd.randrange(3)}", 10**15 + i * 400_000_000, rnd.random() < 0.4) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ip string, us long, hit boolean").withColumn("o", F.col("us"))
    found = state.rearming_flags(df, "ip", "hit")
    assert {r["event_id"]: (r["flagged"], r["raised"]) for r in found.collect()} == flags(rows)
    verdicts = df.selectExpr("ip as detector", "us", "1.0d as d_alpha", "0.0d as d_beta", "7.0d as alpha0", "3.0d as beta0")
    for plan in (found, state.reliability_updates(verdicts)):
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()


def test_only_the_first_ids_of_an_edge_are_collected(spark):
    seen = spark.range(500).selectExpr("'a' as src", "'b' as dst", "'SENT' as edge_type", "1.0d as confidence", "500 - id as us", "id as event_id")
    edges = graph.merged(seen)
    row = edges.first()
    assert row["count"] == 500 and row["ids"] == list(range(499, 449, -1))
    assert "row_number" in edges._jdf.queryExecution().toString()
