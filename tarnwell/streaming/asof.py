"""As-of windows on a stream: what a key did before each event, whatever the order in which events arrive.

An event waits in list state until the watermark has passed its time; then nothing earlier can come any
more, and events of a key are released in order of (us, event_id), each with sums and least values over
the events released before it. So the stream gives what the batch windows give. History stays as long as
the longest window needs it. Events later than the watermark are dropped; a repeated event counts once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import DAY, HOUR
from ..operators.features import LIMITS, near_limit


@dataclass(frozen=True)
class Trailing:
    """A window over the last ``span`` microseconds of a key: ``how`` (sum or min) of ``value``; ``own``: with the event itself."""

    name: str
    span: int
    value: str
    how: str = "sum"
    own: bool = False


class Windows(StatefulProcessor):
    def __init__(self, values: list[str], windows: tuple[Trailing, ...]):
        self.values, self.windows = values, windows
        self.longest = max(w.span for w in windows)
        self.names = ["us", "event_id", *values]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = ", ".join(f"{c} long" for c in self.names)
        self.pending, self.history = (handle.getListState(name, schema) for name in ("pending", "history"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new, times = [], set()
        for part in rows:
            for row in part[self.names].astype(object).where(part[self.names].notna(), None).itertuples(index=False):
                new.append(tuple(None if v is None else int(v) for v in row))
                times.add(-(-new[-1][0] // 1000))
        if new:
            self.pending.appendList(new)
        for at in times:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()]
        due = sorted((r for r in waiting if r[0] <= passed), key=lambda r: r[:2])
        if not due:
            return
        history = [tuple(r) for r in self.history.get()]
        seen, out = {r[:2] for r in history}, []
        for row in due:
            if row[:2] in seen:
                continue
            seen.add(row[:2])
            out.append((*key, row[1], *(self._over(w, history, row) for w in self.windows)))
            history.append(row)
        rest = [r for r in waiting if r[0] > passed]
        self.pending.put(rest) if rest else self.pending.clear()
        kept = [r for r in history if r[0] >= due[-1][0] - self.longest]
        self.history.put(kept)
        if out:
            yield pd.DataFrame(out, columns=["key", "event_id", *(w.name for w in self.windows)]).astype({w.name: "Int64" for w in self.windows})

    def _over(self, w: Trailing, history: list[tuple], row: tuple) -> int | None:
        at = self.names.index(w.value)
        found = [r[at] for r in history if r[0] >= row[0] - w.span and r[at] is not None]
        if w.own and row[at] is not None:
            found.append(row[at])
        return sum(found) if w.how == "sum" else min(found, default=None)

    def close(self) -> None:
        pass


def trailing(events: DataFrame, key: Column, values: dict[str, Column], windows: tuple[Trailing, ...], late: str = "48 hours") -> DataFrame:
    """(key, event_id, windows...) of each event (ts, us, event_id): needs the RocksDB state store."""
    own = events.withWatermark("ts", late).where(key.isNotNull()).select(key.cast("string").alias("key"), "ts", "us", "event_id", *[c.cast("long").alias(n) for n, c in values.items()])
    schema = "key string, event_id long, " + ", ".join(f"{w.name} long" for w in windows)
    return own.groupBy("key").transformWithStateInPandas(Windows(list(values), windows), schema, "append", "eventTime")


def amounts(events: DataFrame, late: str = "48 hours") -> DataFrame:
    """txn_count_1h and txn_sum_24h_paise of each payment, before it."""
    paid = events.where("kind = 'transaction'")
    found = trailing(paid, F.col("customer"), {"amount": F.col("amount"), "one": F.when(F.col("amount").isNotNull(), 1)}, (Trailing("txn_count_1h", HOUR, "one"), Trailing("txn_sum_24h_paise", DAY, "amount")), late)
    return found.drop("key")


def failed_logins(events: DataFrame, late: str = "48 hours") -> DataFrame:
    """failed_logins_1h of each login, before it."""
    return trailing(events.where("kind = 'login'"), F.col("customer"), {"failed": F.when(F.col("result") == "failure", 1)}, (Trailing("failed_logins_1h", HOUR, "failed"),), late).drop("key")


def transfer_windows(events: DataFrame, limits: tuple[int, ...] = LIMITS, late: str = "48 hours") -> DataFrame:
    """The stream form of :func:`tarnwell.operators.features.transfer_windows`."""
    limits, near = tuple(sorted(limits)), near_limit(F.col("amount"), limits)
    is_near = near.isNotNull()
    values = {"amount": F.col("amount"), "one": F.when(F.col("amount").isNotNull(), 1), "near_amount": F.when(is_near, F.col("amount")), "near_us": F.when(is_near, F.col("us")), "at": F.col("us")} | {f"near_{x}": F.when(near == x, 1) for x in limits}
    windows = (
        Trailing("tw_pair_count_24h", DAY, "one", own=True), Trailing("tw_pair_sum_24h_paise", DAY, "amount", own=True), Trailing("tw_pair_count_1h", HOUR, "one", own=True),
        Trailing("tw_near_limit_sum_24h_paise", DAY, "near_amount", own=True), Trailing("first_near", DAY, "near_us", "min", True), Trailing("now", 0, "at", "min", True), *[Trailing(f"near_{x}", DAY, f"near_{x}", own=True) for x in limits],
    )
    rows = trailing(events.where("kind = 'transaction'"), F.to_json(F.struct("customer", "payee")), values, windows, late)
    counts = [F.col(f"near_{x}") for x in limits]
    most, n = F.greatest(*counts), sum(counts[1:], counts[0])
    limit = F.coalesce(*[F.when((c == most) & (most > 0), F.lit(x).cast("long")) for c, x in zip(counts, limits, strict=True)], F.lit(0))
    rate = F.when(n > 0, n / F.greatest(F.lit(1.0), (F.col("now") - F.col("first_near")) / HOUR)).otherwise(0.0)
    return rows.select(
        "event_id", "tw_pair_count_24h", "tw_pair_sum_24h_paise", "tw_pair_count_1h", n.alias("tw_near_limit_count_24h"), "tw_near_limit_sum_24h_paise",
        most.alias("tw_near_limit_same_limit_max_24h"), limit.alias("tw_near_limit_limit_paise"), rate.alias("tw_near_limit_rate_per_h"),
    )
