"""Every query gives rows, and those with SQL DuckDB's rows, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnwell.plans import queries as plans

DATA = "/root/testdata/sf0.001"
#: What these look for needs more customers than the smallest tables have.
LARGER = {name: "/root/testdata/sf0.01" for name in ("d9_w18_insider", "g5_hubs_since")}


def duck(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{folder}/{name}'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    folder = LARGER.get(name, DATA)
    df = plans.queries()[name](spark, folder)
    rows = df.collect()
    assert rows
    sql = plans.oracle_sql().get(name)
    if sql is None:
        return
    found = duck(folder).sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    place = [found.columns.index(c) for c in columns]
    expected = sorted(tuple(shown(r[i]) for i in place) for r in found.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in rows) == expected


def test_entry(spark):
    import __spark_entry__

    found = __spark_entry__.entry(spark)
    rows = found.collect()
    assert rows and {"case_id", "anchor", "items", "p_attack", "band", "rule", "payment_state"} <= set(found.columns)
    assert all(0 < r["p_attack"] <= 1 and r["items"] > 0 for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_bands_floors_patterns_and_rules_occur(spark):
    from tarnwell.operators import policy
    from tarnwell.plans import fusion_queries

    folder = "/root/testdata/sf0.01"
    points = fusion_queries.points(spark, folder)
    seen = {c: {r[0] for r in points.select(c if c == "band" else F.explode(c)).distinct().collect()} for c in ("band", "floors", "patterns")}
    assert seen["band"] == {"LOW", "MEDIUM", "HIGH", "CRITICAL"} and len(seen["floors"]) == 5 and len(seen["patterns"]) == 4
    rules = {r[0] for r in policy.decisions(points).select("rule").distinct().collect()}
    assert rules == {name for name, _, _ in policy.RULES} | {"late_evidence_block"}
