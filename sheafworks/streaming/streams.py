"""Jobs on arriving data: redaction of run files, colour history of users."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sheafworks.operators.redact import holds


def stream_redact(runs: DataFrame, terms: list[str]) -> DataFrame:
    """redact_runs on a stream: stateless, so that any sink and any trigger will do. Terms beyond redact.TERM_BYTES are an error."""
    hit = holds(runs, terms)
    if hit is None:
        raise ValueError("too many terms for a stream")
    return runs.where(~hit)


class Picks(StatefulProcessor):
    """A user's colours, newest first, as typed state; a timer in event time forgets users who pick nothing more."""

    def __init__(self, k: int, idle_ms: int | None):
        self.k, self.idle_ms = k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.history = handle.getValueState("history", "history array<string>")
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key, rows, timerValues):
        history = list(self.history.get()[0]) if self.history.exists() else []
        newest = self.newest.get()[0] if self.newest.exists() else None
        code: dict[str, int] = {}
        kept = []
        for pdf in rows:  # numbers are kept, no rows
            kept.append((pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy(), pdf["event_id"].to_numpy(), np.array([code.setdefault(c, len(code)) for c in pdf["hex"]], np.int32)))
        ts, event, color = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((event, ts))
        ts, color = ts[order], color[order]
        names = list(code)
        for c in color[np.concatenate([[True], color[1:] != color[:-1]])].tolist():
            if names[c] not in history:
                history = [names[c], *history][: self.k]
        last = int(ts[-1]) // 1000
        newest = last if newest is None else max(newest, last)
        self.history.update((history,))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
            self.newest.update((newest,))
            self.handle.registerTimer(newest + self.idle_ms)
        yield pd.DataFrame({"user_id": [key[0]], "history": [history]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.history.clear()
        self.newest.clear()
        yield pd.DataFrame({"user_id": [key[0]], "history": [[]]})

    def close(self) -> None:
        pass


def stream_pick_history(picks: DataFrame, k: int = 16, late: str | None = None, idle: str | None = None) -> DataFrame:
    """(user_id, history): after each micro-batch the lists of the users that it touched.

    The state of a user is at most k strings and a time. Picks of a micro-batch are taken in the order of (ts,
    event_id); of a user's picks a task holds 20 bytes each and the distinct colours. late: picks older than the newest of earlier micro-batches by more
    than that are dropped (watermark); without it none is, and a late pick is taken when it comes. idle: how long after a user's
    last pick, in event time, the history is forgotten, which gives a row with an empty list; it needs late.

    The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    if idle is not None and late is None:
        raise ValueError("histories expire in event time: say how late picks may be")
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    source = picks if late is None else picks.withWatermark("ts", late)
    mode = "None" if idle is None else "EventTime"
    return source.select("user_id", "ts", "event_id", "hex").groupBy("user_id").transformWithStateInPandas(Picks(k, idle_ms), "user_id long, history array<string>", "Update", mode)
