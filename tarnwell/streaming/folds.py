"""Structured Streaming: deduplicated events, tumbling minutes, and keyed folds with event-time state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3_600_000_000


def deduplicated(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Each event_id once, for as long as a repeat may be late."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def failures_by_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(window, n, accounts): failed logins of each minute and how many accounts had them, exactly, as thresholds hang on it."""
    failed = events.where("kind = 'login' and result = 'failure'").withWatermark("ts", late)
    return failed.groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("n"), F.size(F.collect_set("account")).cast("long").alias("accounts"))


def rearming_flags(events: DataFrame, key: str, hit: str, span: int = HOUR, late: str = "24 hours") -> DataFrame:
    """The stream form of :func:`tarnwell.operators.state.rearming_flags`: one number of state per key.

    Rows of a micro-batch come in any order, so a key's rows are gathered and sorted before the fold; an
    idle key's state goes once the watermark has passed its flag."""

    def fold(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(parts)).sort_values(["us", "event_id"])
        at = json.loads(state.get[0]) if state.exists else None
        flagged, raised = [], []
        for us, is_hit in zip(own["us"], own["hit"], strict=True):
            flagged.append(at is not None and us - at < span)
            fresh = bool(is_hit) and (at is None or us - at >= span)
            at = int(us) if fresh else at
            raised.append(fresh)
        state.update((json.dumps(at),))
        state.setTimeoutTimestamp(max(int(own["us"].max() + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": own["event_id"], "key": keys[0], "flagged": flagged, "raised": raised})

    own = events.withWatermark("ts", late).selectExpr("event_id", f"{key} AS key", "us", "ts", f"coalesce({hit}, false) AS hit")
    return own.groupBy("key").applyInPandasWithState(fold, "event_id long, key string, flagged boolean, raised boolean", "at string", "append", GroupStateTimeout.EventTimeTimeout)
