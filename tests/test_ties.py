"""Thousands of events in one instant, against plain Python."""

from bisect import bisect_left

from tarnwell.functions.scalars import HOUR
from tarnwell.operators import features, reports
from tarnwell.sources.bridge import ordered


def test_events_of_one_instant_stay_in_order(spark):
    at = 1_704_067_200_000_000
    times = [at - 1] * 5 + [at] * 3000 + [at + 1] * 3 + [at + 2, at + HOUR - 1, at + HOUR, at + HOUR + 1, at + HOUR + 2]
    rows = [(i, us, "transaction", "c", 100) for i, us in enumerate(times)]
    events = ordered(spark.createDataFrame(rows, "event_id long, us long, kind string, customer string, amount long")).cache()
    assert [r["event_id"] for r in events.orderBy("o").select("event_id").collect()] == list(range(len(times)))
    earlier = {i: i - bisect_left(times, us - HOUR) for i, us in enumerate(times)}
    assert {r["event_id"]: r["txn_count_1h"] for r in features.amounts(events).collect()} == earlier
    assert {r["event_id"]: r["n"] for r in reports.repeated(events, "customer", HOUR).collect()} == {i: n + 1 for i, n in earlier.items()}
