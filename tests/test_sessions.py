"""Stateful sessions over file streams: choices, resets, timers, and a run that goes on."""

import datetime as dt

from test_structure_and_turns import same

from quarryspark.streaming import sessions

SCHEMA = "user_id long, ts timestamp_ntz, kind string, told string"


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def rows_of(df):
    return sorted((r["user_id"], r["session"], r["n_events"], r["product"], r["n_yes"], r["n_no"]) for r in df.collect())


def test_choices_and_resets_over_batches(spark, tmp_path):
    first = [(1, 0, "product", "a"), (1, 1, "offer", None), (1, 2, "answer", "yes"), (1, 3, "answer", "no"), (1, 40, "answer", "yes"), (2, 5, "offer", None), (None, 6, "offer", None), (3, 7, None, None)]
    second = [(1, 41, "offer", None), (1, 42, "answer", "no"), (2, 100, "answer", "yes"), (4, 300, "other", None)]
    for rows in (first, second):
        spark.createDataFrame([(u, at(m), k, t) for u, m, k, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: sessions.drained(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", 900, "0 seconds")
    want = [(1, 1, 4, "a", 1, 0), (1, 2, 3, None, 0, 1), (2, 1, 1, None, 0, 0), (2, 2, 1, None, 0, 0), (3, 1, 1, None, 0, 0)]
    assert rows_of(run()) == want
    spark.createDataFrame([(4, at(302), "product", "z"), (4, at(400), "other", None)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert rows_of(run()) == [*want, (4, 1, 2, "z", 0, 0)]


def test_the_query_is_its_sql(spark):
    same(spark, "stream_sessions")
