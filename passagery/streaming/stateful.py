"""Keyed state: account lockout and answer assembly.

Each micro-batch hands a key its rows of that batch only; the batch size is set by the source's trigger limits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from passagery import constants as K

# the worker that prepares keyed state receives no shipped files, so the processors travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Lockout(StatefulProcessor):
    """Open failures per user, the time of the first of them, and the end of the last lock."""

    def __init__(self, limit: int, minutes: int) -> None:
        self.limit, self.length = limit, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "failures long, since long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # three narrow columns of one key and one micro-batch, as a lock depends on their order
        batch = pd.concat([r[["ts", "event_id", "failed"]] for r in rows]).sort_values(["ts", "event_id"])
        failures, since, until = self.state.get() if self.state.exists() else (0, 0, -(1 << 62))
        clock = batch["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        locks = []
        for now, event, failed in zip(clock.tolist(), batch["event_id"].tolist(), batch["failed"].tolist()):
            if now <= until:
                continue
            since = now if failures == 0 else since
            failures = failures + 1 if failed else 0
            if failures == self.limit:
                failures, until = 0, now + self.length
                locks.append((key[0], event, since, until))
        self.state.update((failures, since, until))
        found = pd.DataFrame(locks, columns=["user_id", "event_id", "since", "locked_until"]).astype("int64")
        times = {c: pd.to_datetime(found[c], unit="us") for c in ("since", "locked_until")}
        yield found.assign(**times)

    def close(self) -> None:
        pass


def lockout_stream(events: DataFrame, limit: int = K.LOCK_FAILURES, minutes: int = K.LOCK_MINUTES) -> DataFrame:
    """`events` (user_id, event_id, ts, failed) in order of arrival per micro-batch; the rules are those of
    `sessions.lockouts`. An account keeps three numbers for ever, as a lock may follow the last failure at any time."""
    return events.groupBy("user_id").transformWithStateInPandas(
        Lockout(limit, minutes), "user_id long, event_id long, since timestamp, locked_until timestamp", "append", "None"
    )


class Assembly(StatefulProcessor):
    """Pieces of an open answer; emitted when it ends, forgotten on an error or when its time is over."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq int, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        content = batch[batch["type"] == "content"]
        if (batch["type"] == "error").any():
            self.pieces.clear()
        elif (batch["type"] == "done").any():
            held = list(self.pieces.get()) + list(zip(content["seq"].tolist(), content["content"].tolist()))
            self.pieces.clear()
            answer = "".join(text for _, text in sorted((int(s), t) for s, t in held))
            yield pd.DataFrame({"session_id": [key[0]], "turn": [key[1]], "answer": [answer]})
        elif len(content):
            self.pieces.appendList([(int(s), t) for s, t in zip(content["seq"], content["content"])])
            self.handle.registerTimer(int(batch["ts"].max().timestamp() * 1000) + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pieces.clear()
        return iter([])

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, ttl_seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """`events` (session_id, turn, seq, type, content, ts): finished answers; unfinished ones lapse by event time."""
    return events.withWatermark("ts", late).groupBy("session_id", "turn").transformWithStateInPandas(
        Assembly(ttl_seconds * 1000), "session_id long, turn long, answer string", "append", "EventTime"
    )
