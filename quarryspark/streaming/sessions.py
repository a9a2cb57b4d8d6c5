"""Conversations as state: a processor with several variables and a timer for each user. A session ends when its user is idle
for long enough; what it knew and what it had asked is then dropped, and only who the user is stays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SESSION = "user_id long, session long, first_ts timestamp_ntz, last_ts timestamp_ntz, n_events long, product string, n_yes long, n_no long"
#: State stores with several variables and timers need this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sessions(StatefulProcessor):
    """Rows (user_id, us, kind, told): `us` the time in microseconds, `kind` what came: a `product` that is told, an `offer`
    that asks for a choice, an `answer` of yes or no to the last offer, or anything else. An answer without an offer in its
    session is none; a second one to an offer neither.

    State: the session (number, times, count), the product it is about, the open offer, and counts of answers. The timer
    stands where the session would end; each event moves it."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "number long, first_us long, last_us long, n long")
        self.product = handle.getValueState("product", "name string")
        self.offer = handle.getValueState("offer", "us long")
        self.answers = handle.getMapState("answers", "answer string", "n long")

    def _load(self) -> dict:
        number, first, last, n = self.session.get() if self.session.exists() else (0, -1, -1, 0)
        answers = {k[0]: v[0] for k, v in self.answers.iterator()} if n and self.answers.exists() else {}
        return {"number": number, "first": first, "last": last, "n": n, "product": self.product.get()[0] if n and self.product.exists() else None, "offer": bool(n) and self.offer.exists(), "answers": answers}

    def _store(self, s: dict) -> None:
        self.session.update((s["number"], s["first"], s["last"], s["n"]))
        for state in (self.product, self.offer, self.answers):
            state.clear()
        if s["product"] is not None:
            self.product.update((s["product"],))
        if s["offer"]:
            self.offer.update((s["last"],))
        for answer, n in s["answers"].items():
            self.answers.updateValue((answer,), (n,))

    def _ended(self, key: tuple, s: dict) -> tuple[dict, dict]:
        """The session's row, and the state without it: everything but its number is reset."""
        row = {"user_id": key[0], "session": s["number"], "first_ts": pd.Timestamp(s["first"], unit="us"), "last_ts": pd.Timestamp(s["last"], unit="us"), "n_events": s["n"], "product": s["product"], "n_yes": s["answers"].get("yes", 0), "n_no": s["answers"].get("no", 0)}
        return row, {"number": s["number"], "first": -1, "last": -1, "n": 0, "product": None, "offer": False, "answers": {}}

    def _timer(self, last_us: int) -> int:
        return (last_us + self.idle_us) // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        events = sorted(((int(us), str(kind), told) for part in rows for us, kind, told in zip(part["us"], part["kind"], part["told"], strict=True)), key=lambda e: e[:2])
        s, out = self._load(), []
        if s["n"]:
            self.handle.deleteTimer(self._timer(s["last"]))
        for us, kind, told in events:  # the state is read and written once, whatever the number of events
            if s["n"] and us - s["last"] >= self.idle_us:
                row, s = self._ended(key, s)
                out.append(row)
            if not s["n"]:
                s |= {"number": s["number"] + 1, "first": us}
            s |= {"last": us, "n": s["n"] + 1}
            if kind == "product":
                s["product"] = told
            elif kind == "offer":
                s["offer"] = True
            elif kind == "answer" and s["offer"]:
                s["answers"][told] = s["answers"].get(told, 0) + 1
                s["offer"] = False
        self._store(s)
        self.handle.registerTimer(self._timer(s["last"]))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = self._load()
        if s["n"]:
            row, s = self._ended(key, s)
            self._store(s)
            yield pd.DataFrame([row])

    def close(self) -> None:
        """Nothing is held outside the state."""


def closed_sessions(events: DataFrame, idle_seconds: int = 900, late: str = "1 hour") -> DataFrame:
    """SESSION rows of a stream (user_id, ts, kind, told), each when its session has ended: by the next event of the user, or
    by its timer once the watermark has passed it. Events behind the watermark, and those without a user or a time, are
    dropped. The product is the last one told in the session."""
    events.sparkSession.conf.set(*PROVIDER)
    known = events.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = known.select("user_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("told"))
    return rows.groupBy("user_id").transformWithStateInPandas(Sessions(idle_seconds * 1_000_000), SESSION, "Append", "EventTime")


def drained(spark: SparkSession, source: str, schema: str, path: str, idle_seconds: int = 900, late: str = "1 hour", files: int = 1) -> DataFrame:
    """Reads all that is in a folder of Parquet files, oldest first, some files at a time, as one stream that ends, and gives
    the sessions that it closed, written under path. Started again on the same path, it goes on from where it was."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = closed_sessions(events, idle_seconds, late).writeStream.format("parquet").option("path", f"{path}/sessions").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(SESSION).parquet(f"{path}/sessions")
