"""Streams over files, read to their end."""

import datetime as dt

from pyspark.sql import functions as F

from quarryspark.streaming import operators as st


def _source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def _drain(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_first_seen(spark, tmp_path):
    rows = [("m1", at(0)), ("m1", at(5)), ("m2", at(9))]
    got = _drain(st.first_seen(_source(spark, tmp_path, rows, "id string, ts timestamp"), ["id"], "ts"), tmp_path, "seen")
    assert sorted(r["id"] for r in got.collect()) == ["m1", "m2"]


def test_idle_sessions_close_at_the_limit(spark, tmp_path):
    rows = [(1, at(0)), (1, at(899)), (1, at(1799)), (2, at(10))]
    got = _drain(st.idle_sessions(_source(spark, tmp_path, rows, "user_id long, ts timestamp")), tmp_path, "idle")
    closed = [(r["user_id"], r["session"], r["n_events"]) for r in got.collect()]
    assert (1, 1, 2) in closed


def test_upsert_by_micro_batch(spark, tmp_path):
    seen = []
    events = _source(spark, tmp_path, [(1, at(0)), (2, at(1))], "user_id long, ts timestamp")
    st.upsert_to(events, str(tmp_path / "cp"), lambda batch, n: seen.append(batch.agg(F.count("*")).first()[0])).awaitTermination(120)
    assert sum(seen) == 2
