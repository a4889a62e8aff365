"""Operators whose state depends on their own earlier output: folds over one key's ordered events.

The same fold serves a batch (sorted events of each key) and a stream (state per key); see
:mod:`tarnwell.streaming.folds`. In a batch a task reads its keys' events sorted, in parts, and carries the state of
one key from part to part, so memory does not grow with a key's events; one key's events are read by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Networks that hide who is behind them.
ANONYMISING = ("hosting", "vpn", "tor")


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, schema: str) -> DataFrame:
    """``start()`` gives a key's fold, which takes that key's next events in order and gives rows of ``schema``.

    Rows without a key have nothing in common: each is folded by itself, and they are dealt to all tasks.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold = None, None
        for part in parts:
            alone = part[key].isna()
            for _, own in part.groupby(((part[key] != part[key].shift()) | alone).cumsum(), sort=False):
                now = own[key].iloc[0]
                if fold is None or pd.isna(now) or now != at:
                    at, fold = now, start()
                yield fold(own)

    return rows.repartition(key, F.when(F.col(key).isNull(), F.xxhash64(*order))).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def folded_rows(rows: DataFrame, key: str, order: list[str], start: Callable, schema: str) -> DataFrame:
    """Like :func:`folded`, for keys of few rows (none null): ``start()`` gives a fold whose ``step(row)`` and ``end()`` give tuples of
    ``schema``. What a part gives is one frame, however many keys it holds."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def frame(out: list[tuple]) -> pd.DataFrame:
        df = pd.DataFrame(out, columns=columns).astype(object)
        return df.where(df.notna(), None) if out else df

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold = None, None
        for part in parts:
            out: list[tuple] = []
            for now, row in zip(part[key].tolist(), part.itertuples(index=False), strict=True):
                if fold is None or now != at:
                    out.extend(fold.end() if fold is not None else ())
                    at, fold = now, start()
                out.extend(fold.step(row))
            yield frame(out)
        if fold is not None:
            yield frame(list(fold.end()))

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rearming_flags(rows: DataFrame, key: str, hit: str, span: int = HOUR) -> DataFrame:
    """(event_id, key, flagged, raised): a hit raises the flag for ``span``; flagged is its state before the event."""

    def start():
        at = None

        def fold(own: pd.DataFrame) -> pd.DataFrame:
            nonlocal at
            flagged, raised = [], []
            for us, is_hit in zip(own["us"], own["hit"], strict=True):
                flagged.append(at is not None and us - at < span)
                fresh = bool(is_hit) and (at is None or us - at >= span)
                at = us if fresh else at
                raised.append(fresh)
            return own.assign(flagged=flagged, raised=raised)[["event_id", "key", "flagged", "raised"]]

        return fold

    own = rows.selectExpr("event_id", f"{key} AS key", "us", "o", f"coalesce({hit}, false) AS hit")
    return folded(own, "key", ["o"], start, "event_id long, key string, flagged boolean, raised boolean")


class Session:
    """The first-seen context of a session and which changed contexts were already reported."""

    fields = ("asn", "network_type", "device", "platform", "gpu", "customer")
    bits = dict(zip(fields, (1, 2, 4, 8, 16, 32), strict=True))

    def __init__(self) -> None:
        self.seen: dict[str, str] = {}
        self.at: int | None = None
        self.reported: set[tuple] = set()

    def step(self, event: dict, ttl: int) -> tuple[bool, int, bool]:
        """(seen before, mask of changes, report) for the event; then the context takes it in."""
        live = self.at is not None and event["us"] - self.at <= ttl
        if not live:
            self.seen, self.reported = {}, set()
        mask = 0
        for f in self.fields:
            old, new = self.seen.get(f), event.get(f)
            if old and new and old != new and not (f == "network_type" and "unknown" in (old, new)):
                mask |= self.bits[f]
        if mask & 3 and event.get("network_type") in ANONYMISING and self.seen.get("network_type") not in ANONYMISING:
            mask |= 64
        suspicious = bool(mask & 3) and bool(mask & 60)
        signature = tuple(event.get(f) for f in self.fields)
        report = suspicious and signature not in self.reported
        if suspicious and len(self.reported) < 16:
            self.reported.add(signature)
        for f in self.fields:
            if event.get(f):
                self.seen.setdefault(f, event[f])
        self.at = event["us"] if not live else max(self.at, event["us"])
        return live, mask, report

    def steps(self, own: pd.DataFrame, ttl: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What :meth:`step` gives for each of these events, which are in order, by columns."""
        n, us = len(own), own["us"].to_numpy(np.int64)
        live, mask, report = np.ones(n, bool), np.zeros(n, np.int32), np.zeros(n, bool)
        if not n:
            return live, mask, report
        last = np.maximum.accumulate(us if self.at is None else np.append(self.at, us))
        live[1:], live[0] = us[1:] - last[-n:-1] <= ttl, self.at is not None and us[0] - self.at <= ttl
        if not live[0]:
            self.seen, self.reported = {}, set()
        start, at = np.append(0, 1 + np.flatnonzero(~live[1:])), np.arange(n)
        span = np.searchsorted(start, at, "right") - 1
        values = {f: own[f].astype(object).where(own[f].notna(), None).to_numpy() if f in own else np.full(n, None, object) for f in self.fields}
        codes, firsts, hidden = [], {}, None
        for f in self.fields:
            code, kinds = pd.factorize(np.append(np.array([self.seen.get(f)], object), values[f]))
            real = np.array([bool(x) for x in kinds] + [False])  # the last one is of nulls, whose code is -1
            found = np.where(real[code[1:]], at, n)
            first = np.minimum.reduceat(found, start)
            old = np.where(first < n, code[1:][np.minimum(first, n - 1)], -1)
            if real[code[0]]:
                first[0], old[0] = -1, code[0]
            codes.append(code[1:])
            firsts[f] = old[-1]
            self_old, shown = np.where(first[span] < at, old[span], -1), real[code[1:]]
            other = shown & (self_old >= 0) & (self_old != code[1:])
            if f == "network_type":
                named = lambda names: np.array([x in names for x in kinds] + [False])
                other &= ~(named(("unknown",))[code[1:]] | named(("unknown",))[self_old])
                hidden = named(ANONYMISING)[code[1:]] & ~named(ANONYMISING)[self_old]
            mask[other] |= self.bits[f]
            firsts[f] = kinds[old[-1]] if old[-1] >= 0 else None
        mask[((mask & 3) > 0) & hidden] |= 64
        bad = np.flatnonzero(((mask & 3) > 0) & ((mask & 60) > 0))
        alike = span[bad]
        for code in codes:
            alike = pd.factorize(alike * (int(code.max()) + 2) + code[bad] + 1)[0]
        signed = lambda i: tuple(values[f][i] for f in self.fields)
        _, new = np.unique(alike, return_index=True)  # the first event of each span and signature, in order
        kept, room = np.ones(len(new), bool), 16 - len(self.reported)
        told = np.array([span[bad[i]] == 0 and signed(bad[i]) in self.reported for i in new], bool)
        place = pd.Series(span[bad[new]][~told]).groupby(span[bad[new]][~told]).cumcount().to_numpy()
        kept[~told] = place < np.where(span[bad[new]][~told] == 0, room, 16)
        report[bad] = ~kept[alike]
        report[bad[new]] = ~told
        if len(start) > 1:
            self.reported = set()
        self.reported |= {signed(bad[i]) for i in new[kept & ~told] if span[bad[i]] == span[-1]}
        self.seen, self.at = {f: x for f, x in firsts.items() if x}, int(last[-1])
        return live, mask, report


def sessions(rows: DataFrame, ttl: int = 24 * HOUR) -> DataFrame:
    """(event_id, session_seen, session_change_mask, session_change) over each session's events."""

    def start():
        state = Session()

        def fold(own: pd.DataFrame) -> pd.DataFrame:
            seen, mask, report = state.steps(own, ttl)
            return pd.DataFrame({"event_id": own["event_id"].to_numpy(), "session_seen": seen, "session_change_mask": mask, "session_change": report})

        return fold

    return folded(rows, "session", ["o"], start, "event_id long, session_seen boolean, session_change_mask int, session_change boolean")


def reliability_updates(feedback: DataFrame, half_life_days: float = 30.0, most: float = 1.0, batch: float = 3.0, batch_h: float = 24.0, bounds: tuple[float, float] = (0.20, 0.95)) -> DataFrame:
    """(detector, us, alpha, beta): reliability after each verdict, decayed to its prior and kept in bounds.

    feedback: detector, us, d_alpha, d_beta, alpha0, beta0 (the prior)."""

    def start():
        state = (None, None, None, [])

        def fold(own: pd.DataFrame) -> pd.DataFrame:
            nonlocal state
            state, out = after(own, *state)
            return out

        return fold

    def after(own: pd.DataFrame, a: float | None, b: float | None, last: int | None, used: list) -> tuple[tuple, pd.DataFrame]:
        out, (low, high) = [], bounds
        for r in own.itertuples():
            if a is None:
                a, b = r.alpha0, r.beta0
            if last is not None and r.us > last:
                f = 0.5 ** ((r.us - last) / (half_life_days * 24 * HOUR))
                a, b = r.alpha0 + (a - r.alpha0) * f, r.beta0 + (b - r.beta0) * f
            used = [(t, s) for t, s in used if r.us - t <= batch_h * HOUR]
            step = max(r.d_alpha, r.d_beta)
            scale = min(1.0, most / step if step else 1.0)
            room = max(0.0, batch - sum(s for _, s in used))
            if step * scale > room:
                scale = room / step
            da, db = r.d_alpha * scale, r.d_beta * scale
            if da > 0:
                da = min(da, max(0.0, high * b / (1 - high) - a))
            if db > 0:
                db = min(db, max(0.0, a / low - a - b))
            a, b, last = a + da, b + db, r.us
            if max(da, db) > 0:
                used.append((r.us, max(da, db)))
            out.append((r.detector, r.us, a, b))
        return (a, b, last, used), pd.DataFrame(out, columns=["detector", "us", "alpha", "beta"])

    return folded(feedback, "detector", ["us", "d_alpha", "d_beta"], start, "detector string, us long, alpha double, beta double")


def chained(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(event_id, row_hash, prev_hash) of an audit log: a row's hash is of the hash before it in its chain and of
    its body, so a row that is changed or taken out breaks the chain from there on."""

    def start():
        last = ""

        def fold(own: pd.DataFrame) -> pd.DataFrame:
            nonlocal last
            found, before = [], []
            for body in own["body"]:
                before.append(last)
                last = hashlib.sha256(f"{last}|{body}".encode()).hexdigest()
                found.append(last)
            return pd.DataFrame({"event_id": own["event_id"], "row_hash": found, "prev_hash": before})

        return fold

    return folded(rows, key, order, start, "event_id long, row_hash string, prev_hash string")


def broken(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of an audit log (key, order, event_id, body, row_hash, prev_hash) that their hashes do not bear out."""
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(key).orderBy(*order)), F.lit(""))
    own = F.sha2(F.concat_ws("|", F.col("prev_hash"), F.col("body")), 256)
    return log.withColumns({"linked": before == F.col("prev_hash"), "own": own}).where((F.col("own") != F.col("row_hash")) | ~F.col("linked")).drop("linked", "own")
