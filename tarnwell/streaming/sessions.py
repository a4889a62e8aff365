"""Sessions on a stream that tell at once and correct what they told.

Each event gets its verdict in the batch it comes in (revision 0), from what the session has shown up to then. An
event that comes late, but not below the watermark, may change the verdicts of events after it: those are told
again under the next revision. The last revision of an event is the batch's verdict (:func:`latest`).

State of a session: its context up to the watermark, before which nothing can come any more, and the events since
with what was told of them, as a few values of many rows each, which are folded by columns. Both go once the watermark has passed the last event by the session's time to live.
Events below the watermark are dropped; an event that comes twice counts once, and rows without a session are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import HOUR, Session

#: Columns of the state's events: when, which, its context and what was told of it last (-1 before); and how many one value holds.
EVENT, PART = ("us", "event_id", *Session.fields, "seen", "mask", "report", "revision"), 100_000
TOLD = "session string, event_id long, revision int, session_seen boolean, session_change_mask int, session_change boolean"


def packed(state: Session) -> str:
    return json.dumps([state.seen, state.at, sorted(state.reported, key=str)])


def unpacked(text: str | None) -> Session:
    state = Session()
    if text is not None:
        state.seen, state.at, reported = json.loads(text)
        state.reported = {tuple(x) for x in reported}
    return state


#: The state's events as Arrow has them.
SCHEMA = pa.schema([(c, pa.string() if c in Session.fields else pa.int64()) for c in EVENT])


def _bytes(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, SCHEMA) as to:
        to.write_table(pa.Table.from_pandas(rows, SCHEMA, preserve_index=False))
    return out.getvalue().to_pybytes()


class Sessions(StatefulProcessor):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "context string, timer long")
        self.open = handle.getListState("open", "events binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [pa.ipc.open_stream(part[0]).read_pandas() for part in self.open.get()]
        kept += [part[["us", "event_id", *Session.fields]].assign(seen=-1, mask=-1, report=-1, revision=-1) for part in rows]
        # of an event that comes twice, the one that came first stays
        all_ = pd.concat([part for part in kept if len(part)], ignore_index=True).drop_duplicates(["us", "event_id"]).sort_values(["us", "event_id"], ignore_index=True)
        context, timer = self.settled.get() if self.settled.exists() else (None, None)
        state, passed = unpacked(context), timerValues.getCurrentWatermarkInMs() * 1000
        done = int((all_["us"] <= passed).sum())
        before = state.steps(all_[:done], self.ttl)
        settled = packed(state) if done else context
        now = [np.concatenate(x).astype(int) for x in zip(before, state.steps(all_[done:], self.ttl), strict=True)]
        changed = np.any([all_[c].to_numpy() != x for c, x in zip(("seen", "mask", "report"), now, strict=True)], axis=0)
        all_ = all_.assign(seen=now[0], mask=now[1], report=now[2], revision=all_["revision"] + changed)
        rest = all_.loc[done:, list(EVENT)]
        parts = [(_bytes(rest[i : i + PART]),) for i in range(0, len(rest), PART)]
        self.open.put(parts) if parts else self.open.clear()
        self._keep(settled, timer, -(-(state.at + self.ttl) // 1000))
        told = all_[changed]
        if len(told):
            yield pd.DataFrame({"session": key[0], "event_id": told["event_id"], "revision": told["revision"], "session_seen": told["seen"] == 1, "session_change_mask": told["mask"].astype("int32"), "session_change": told["report"] == 1})

    def _keep(self, settled: str | None, timer: int | None, until: int) -> None:
        """One timer a session: at the end of its time to live."""
        if timer != until:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)
        self.settled.update((settled, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.settled.clear()
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def sessions(events: DataFrame, ttl: int = 24 * HOUR, late: str = "24 hours") -> DataFrame:
    """(session, event_id, revision, session_seen, session_change_mask, session_change) of a stream of events (ts, us, event_id,
    session and the context's fields): the stream form of :func:`tarnwell.operators.state.sessions`. Needs the RocksDB state store."""
    own = events.withWatermark("ts", late).where("session is not null").select(F.col("session").cast("string"), "ts", "us", "event_id", *[F.col(f).cast("string") for f in Session.fields])
    return own.groupBy("session").transformWithStateInPandas(Sessions(ttl), TOLD, "append", "eventTime")


def latest(told: DataFrame) -> DataFrame:
    """The last verdict told of each event, and how often it was corrected."""
    verdict = ["session_seen", "session_change_mask", "session_change"]
    last = told.groupBy("session", "event_id").agg(F.max_by(F.struct(*verdict), "revision").alias("v"), F.max("revision").alias("corrections"))
    return last.select("session", "event_id", *[F.col(f"v.{c}") for c in verdict], "corrections")
