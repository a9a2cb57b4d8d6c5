"""Structured Streaming forms of the stateful operators: first-seen claims, idle sessions, upserts from micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def first_seen(events: DataFrame, keys: list[str], ts: str, ttl: str = "24 hours") -> DataFrame:
    """Drops events whose keys came within the time to live, by event time; the state of a key ends with it."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


SESSION = "user_id long, session long, first_ts timestamp, last_ts timestamp, n_events long"
STATE = "session long, first_us long, last_us long, n long"


def idle_sessions(events: DataFrame, idle_seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """Sessions of (user_id, ts) that end where a user is idle for at least idle_seconds. A gap of just that length
    ends a session, which session_window would merge. A closed session is emitted at once, an open one when its timer
    has passed; events behind the watermark are dropped."""

    def row(key: int, state: tuple) -> dict:
        session, a, b, n = state
        return {"user_id": key, "session": session, "first_ts": pd.Timestamp(a, unit="us"), "last_ts": pd.Timestamp(b, unit="us"), "n_events": n}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, own = [], tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([row(key[0], own)])
            return
        for at in sorted(int(t.value // 1000) for batch in batches for t in batch["ts"]):
            if own is None:
                own = (1, at, at, 1)
            elif at - own[2] >= idle_seconds * 1_000_000:
                out.append(row(key[0], own))
                own = (own[0] + 1, at, at, 1)
            else:
                own = (own[0], min(own[1], at), max(own[2], at), own[3] + 1)
        state.update(own)
        state.setTimeoutTimestamp(max(own[2] // 1000 + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out)

    timed = events.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, SESSION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, by, n): tumbling windows, late events up to the watermark counted."""
    found = events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), by, "n")


def upsert_to(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch to write(batch, number), which must bear a batch coming twice, until the source is read."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
