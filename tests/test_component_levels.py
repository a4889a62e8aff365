"""Components of items in order of time take few steps."""

import random

from tarnwell.operators import components


def test_items_in_order_are_components_in_few_steps(spark, monkeypatch):
    """Chains of items in order of time, dealt to parts at random: rounds of joins would take dozens of steps."""
    monkeypatch.setattr(components, "MOST", 400)
    kept, calls = components.stable, []
    monkeypatch.setattr(components, "stable", lambda df: calls.append(1) or kept(df))
    edges = [(i, i + 3) for i in range(3000) if i % 50 < 40]
    random.Random(1).shuffle(edges)
    over = list(range(3003))
    for a, b in sorted(edges):
        over[b] = over[a]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {n: over[n] for e in edges for n in e}
    assert len(calls) <= 6
