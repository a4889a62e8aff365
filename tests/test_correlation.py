"""The discount of correlated evidence against its definition."""

import pytest

from tarnwell.functions.scalars import MINUTE
from tarnwell.operators import correlation, fusion
from tarnwell.plans import fusion_queries

GROUP = (correlation.Group("corr_NEW_DEVICE", ("NEW_DEVICE", "MFA_CHANGED_AFTER_NEW_DEVICE")),)
SCHEMA = "case_id string, evidence_id long, us long, family string, contribution double, reasons array<string>, customers array<string>"


def item(i, minutes, family, worth, reason, customer="cust:a"):
    return ("c", i, minutes * MINUTE, family, worth, [reason], [customer] if customer else [])


def brute(rows, groups, window):
    """Group after group over each whole case, as the rule is told."""
    out = {}
    for g in groups:
        for case in sorted({r[0] for r in rows}):
            members = [r for r in rows if r[0] == case and r[4] > 0 and (case, r[1]) not in out and set(r[5]) & set(g.reasons)]
            kept = []
            for r in sorted(members, key=lambda r: (-r[4], r[2], r[1])):
                partner = next((k for k in kept if k[3] != r[3] and set(k[6]) & set(r[6]) and abs(k[2] - r[2]) <= window), None)
                if partner is None:
                    kept.append(r)
                else:
                    out[case, r[1]] = (g.name, partner[1], g.factor)
    return out


def found(spark, rows, groups=GROUP, window=60 * MINUTE):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
    return {(r["case_id"], r["evidence_id"]): (r["group"], r["kept"], r["factor"]) for r in correlation.discounts(df, groups, window).collect()}


def test_the_weaker_item_of_one_fact_counts_half(spark):
    weak, strong = item(1, 0, "identity", 0.99, "NEW_DEVICE"), item(2, 3, "device", 1.29, "MFA_CHANGED_AFTER_NEW_DEVICE")
    assert found(spark, [weak, strong]) == {("c", 1): ("corr_NEW_DEVICE", 2, 0.5)}
    df = spark.createDataFrame([weak, strong], SCHEMA)
    left = {r["evidence_id"]: r["contribution"] for r in correlation.discounted(df, correlation.discounts(df, GROUP)).collect()}
    assert left == {1: pytest.approx(0.495), 2: pytest.approx(1.29)}


@pytest.mark.parametrize("other", [item(2, 3, "device", 1.29, "MFA_CHANGED_AFTER_NEW_DEVICE", "cust:b"), item(2, 61, "device", 1.29, "MFA_CHANGED_AFTER_NEW_DEVICE"), item(2, 3, "identity", 1.29, "MFA_CHANGED_AFTER_NEW_DEVICE"), item(2, 3, "device", -1.0, "NEW_DEVICE"), item(2, 3, "device", 1.29, "NEW_DEVICE", None)])
def test_pairs_need_a_customer_the_window_and_another_family(spark, other):
    rows = [item(1, 0, "identity", 0.99, "NEW_DEVICE"), other]
    assert found(spark, rows) == {} == found(spark, rows, ())


def test_the_query_is_the_definition(spark):
    items = fusion.contributions(fusion_queries.evidence(spark, "/root/testdata/sf0.001")).selectExpr("*", "array(customer) AS customers")
    rows = [tuple(r) for r in items.select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    want = brute(rows, fusion_queries.GROUPS, 360 * MINUTE)
    assert len({v[0] for v in want.values()}) == 2
    assert found(spark, items, fusion_queries.GROUPS, 360 * MINUTE) == want
