"""Attributions of boosted trees against the definition of Shapley values, subset by subset."""

from itertools import combinations
from math import factorial

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import attributions, models
from tarnwell.plans import analytics_queries, queries

NAMES = ("a", "b", "c", "d")


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(500).select("id", *[F.round(F.rand(i), 2).alias(c) for i, c in enumerate(NAMES)])
    df = df.withColumn("y", (F.col("a") + F.col("b") * F.col("c") + F.rand(9) / 5 > 0.85).cast("int")).withColumn("c", F.when(F.col("id") % 9 > 0, F.col("c")))
    df = df.cache()
    return models.fitted(df.where("id < 400"), df.where("id >= 400"), NAMES, trees=True).model, df


def expected_with(nodes, at, x, known):
    """The tree's mean over what is not known, by training weight."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return node["prediction"]
    f, (t, *_), _ = node["split"]
    if f in known:
        return expected_with(nodes, node["leftChild" if x[f] <= t else "rightChild"], x, known)
    weight = lambda side: nodes[node[side]]["impurityStats"][0] / node["impurityStats"][0]
    return sum(weight(side) * expected_with(nodes, node[side], x, known) for side in ("leftChild", "rightChild"))


def test_values_are_shapleys(spark, fitted, tmp_path):
    model, df = fitted
    model.save(str(tmp_path / "m"))
    trees = {}
    for row in spark.read.parquet(str(tmp_path / "m" / "data")).select("treeID", "nodeData.*").collect():
        trees.setdefault(row["treeID"], {})[row["id"]] = row
    mean = lambda x, known: sum(model.treeWeights[t] * expected_with(nodes, 0, x, known) for t, nodes in trees.items())
    got = attributions.attributed(model, df.where("id % 25 = 3 or id < 19"), NAMES, "id").collect()
    assert len(got) > 30 and any(r["features"][2]["value"] == 0 for r in got)
    for r in got:
        x = [f["value"] for f in r["features"]]
        for j, f in enumerate(r["features"]):
            others, want = [i for i in range(4) if i != j], 0.0
            for size in range(4):
                for s in combinations(others, size):
                    want += factorial(size) * factorial(3 - size) / 24 * (mean(x, {*s, j}) - mean(x, set(s)))
            assert f["feature"] == NAMES[j] and f["added"] == pytest.approx(want, abs=1e-9)
        assert r["expected"] + sum(f["added"] for f in r["features"]) == pytest.approx(r["margin"], abs=1e-9)
        assert r["expected"] == pytest.approx(mean(x, set()), abs=1e-9)


def test_no_rows_and_long_paths(spark, fitted):
    model, df = fitted
    assert attributions.attributed(model, df.limit(0), NAMES, "id").collect() == []
    shares = [0.5] * 12
    assert attributions.table(shares, 2.0)[-1].sum() == pytest.approx(2.0 - 2.0 * 0.5**12)


def test_order_of_features_and_reasons(spark):
    part = lambda f, added: {"feature": f, "value": 1.0, "added": added}
    rows = [([part("log_amount", -3.0), part("txn_count_1h", 2.0), part("payee_passthrough_24h", 2.5), part("payee_is_new", 2.0), part("hour_deviation", 0.0), part("payee_fan_in_24h", 0.1)],), ([],)]
    df = spark.createDataFrame(rows, "features array<struct<feature:string,value:double,added:double>>")
    got = df.select(attributions.strongest().alias("s"), attributions.reasons().alias("r")).collect()
    assert [x["feature"] for x in got[0]["s"]] == ["log_amount", "payee_passthrough_24h", "txn_count_1h", "payee_is_new", "payee_fan_in_24h"]
    assert got[0]["r"] == ["TXN_VELOCITY_1H", "NEW_PAYEE", "PAYEE_FAN_IN"] and got[1]["s"] == got[1]["r"] == []


def test_the_query_tells_every_later_payment(spark):
    rows = queries.queries()["s6_d12_attributions"](spark, "/root/testdata/sf0.001").collect()
    _, later = analytics_queries.payment_model(spark, "/root/testdata/sf0.001")
    assert {r["event_id"] for r in rows} == {r["event_id"] for r in later.select("event_id").collect()}
    assert all(abs(r["margin"] - r["sum_of_parts"]) < 2e-6 and len(r["strongest"].split(",")) == 5 for r in rows) and any(r["reasons"] for r in rows)
