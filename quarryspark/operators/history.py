"""Conversation history: latest turns, details, compaction, idle sessions, first-seen claims, status pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_turns(turns: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The last turn of each conversation with its number of turns, newest conversations first."""
    own = Window.partitionBy("conv_id")
    rows = turns.withColumn("place", F.row_number().over(own.orderBy(F.desc("turn")))).withColumn("n_turns", F.count("*").over(own)).where("place = 1").drop("place")
    return rows if limit is None else rows.orderBy(F.desc("turn"), "conv_id").offset(offset).limit(limit)


def messages(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_turns, text): every turn with its whole text and its conversation's number of turns."""
    return turns.select("conv_id", "turn", "role", F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"), "text")


def details(turns: DataFrame, most_characters: int = 40) -> DataFrame:
    """(conv_id, n_turns, roles, opening): a digest on one row, the roles in order and how the first text begins. Roles
    are collected, texts are not; `messages` has them whole."""
    ordered, first = F.array_sort(F.collect_list(F.struct("turn", "role"))), F.min(F.struct("turn", "role", "text"))
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), ordered.alias("t"), first.alias("first"))
    return rows.select("conv_id", "n_turns", F.array_join("t.role", ">").alias("roles"), F.substring("first.text", 1, most_characters).alias("opening"))


def compacted(turns: DataFrame, last: int = 6, most_characters: int = 250) -> DataFrame:
    """The last turns of each conversation, their trimmed texts cut."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("place", place).where(F.col("place") <= last).select("conv_id", "turn", "role", F.substring(F.trim("text"), 1, most_characters).alias("content"))


def idle_sessions(events: DataFrame, key: str, ts: str, idle_seconds: int = 900) -> DataFrame:
    """Adds `idle_seconds` and `session`, which rises where the key was idle for at least idle_seconds."""
    own = Window.partitionBy(key).orderBy(ts, "event_id")
    idle = F.greatest(F.lit(0.0), F.unix_micros(F.col(ts).cast("timestamp")) / 1e6 - F.lag(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).over(own))
    rows = events.withColumn("idle_seconds", F.bround(idle, 3))
    return rows.withColumn("session", F.sum(F.coalesce((F.col("idle_seconds") >= idle_seconds).cast("int"), F.lit(0))).over(own) + 1)


def first_claims(events: DataFrame, keys: list[str], ts: str, order: str, ttl_seconds: int = 86_400) -> DataFrame:
    """The rows that claim their key: the first, and then the first at least ttl_seconds after the last claim. Rows come
    to a key's task in order, and a task holds one key's last claim."""
    schema = events.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, None
        for batch in batches:
            keep = []
            for *key, at in zip(*(batch[k].to_pylist() for k in [*keys, "_us"]), strict=True):
                claims = key != own or at - last >= ttl_seconds * 1_000_000
                if claims:
                    own, last = key, at
                keep.append(claims)
            yield batch.filter(pa.array(keep)).drop_columns(["_us"])

    timed = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return timed.repartition(*keys).sortWithinPartitions(*keys, "_us", order).mapInArrow(run, schema)


def status_page(rows: DataFrame, status: str | None, column: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    rows = rows if status is None else rows.where(F.col(column) == status)
    return rows.orderBy(*order).offset(offset).limit(limit)
