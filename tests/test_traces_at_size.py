"""Registered queries of traces leave nothing behind."""

import pytest
from pyspark.sql import functions as F

from quarryspark.plans import trace_queries
from quarryspark.sources import scratch


@pytest.mark.parametrize("name", trace_queries.QUERIES)
def test_traces_are_not_stored(spark, tmp_path, monkeypatch, name):
    """All traces were written as JSON lines, a hundred times the events."""
    monkeypatch.setattr(scratch, "folder", None)
    rows = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("props"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    found = trace_queries.QUERIES[name](spark, str(tmp_path))
    assert found.count() >= 5 and ("trace_id" not in found.columns or found.select("trace_id").distinct().count() <= 40)


@pytest.mark.parametrize("name", trace_queries.QUERIES)
def test_events_are_dealt_out_unsorted(spark, tmp_path, name):
    """A table in one file was sorted whole in the task that reads it, to deal its rows in turn."""
    rows = spark.range(40).select(F.col("id").alias("event_id"), (F.col("id") % 5).alias("user_id"), F.lit("view").alias("event_type"), F.col("id").cast("double").alias("value"), F.concat(F.lit('{"k": '), F.col("id"), F.lit("}")).alias("props"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    plan = trace_queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event_id" in plan and "RoundRobin" not in plan
