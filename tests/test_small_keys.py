"""Folds over many small keys give one frame a part; a case is told once a slice; what nobody looks for links nothing."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import joiner, state

T = 1_704_067_200_000_000
ITEM = "evidence_id string, us long, customer string, stage string, p double, weight double, family string, entities array<string>, tokens array<string>, bridges array<string>, odd array<string>"


class Count:
    def __init__(self):
        self.n = 0

    def step(self, r):
        self.n += 1
        return [(r.key, r.us, self.n)]

    def end(self):
        return [(0, -1, self.n)] if self.n > 1 else []


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_share_a_frame_and_span_parts(spark, small_parts):
    rows = spark.range(100).selectExpr("id div 9 as key", "id as us")
    found = [tuple(r) for r in state.folded_rows(rows, "key", ["us"], Count, "key long, us long, n long").collect()]
    assert sorted(x for x in found if x[1] >= 0) == [(i // 9, i, i % 9 + 1) for i in range(100)]
    assert sorted(x[2] for x in found if x[1] < 0) == [9] * 11


def items(spark, rows):
    return spark.createDataFrame([(i, T + us, c, "S2_CONTROL_TAKEOVER", 0.5, 1.0, "device", [c, *seen], [c, *tokens], list(payees), list(odd)) for i, us, c, seen, tokens, payees, odd in rows], ITEM)


def test_a_case_is_told_once_a_slice(spark, small_parts):
    rows = items(spark, [(f"e{i:03}", i, "cust:1", (), (), (), ()) for i in range(100)]).withColumn("what", F.lit(joiner.ITEM))
    told = joiner._slice(rows, None, 0.01).where("what = 'case'").collect()
    assert [len(told), told[0]["case_id"]] == [1, "case:e000"]


def test_what_nobody_looks_for_links_nothing(spark):
    rows = [(f"e{i}", i, f"cust:{i}", ("ip:3", "acct:9"), ("acct:9",), ("acct:9",), ()) for i in range(4)] + [("f0", 9, "cust:8", ("dev:1",), ("dev:1",), (), ()), ("f1", 10, "cust:9", ("dev:1",), ("dev:1",), (), ())]
    df = items(spark, rows).withColumns({"what": F.lit(joiner.ITEM), "all": F.array_union("tokens", "entities"), "node": joiner._node(F.col("customer"), F.col("evidence_id"))})
    shared = joiner._edges(df, 0.01).groupBy("a").agg(F.countDistinct("b").alias("n")).where("n > 1")
    assert [r["n"] for r in shared.collect()] == [2]
    assert joiner.join_cases(items(spark, rows))[1].count() == 5
