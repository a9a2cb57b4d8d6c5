"""Diagnoses of vectors compare them once, and agree with their SQL."""

import duckdb
import pytest

from quarryspark.operators import retrieval
from quarryspark.plans import diagnosis_queries as dq
from quarryspark.plans import evaluation_queries as eq

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["vector_causes", "light_causes", "unified_causes"])
def test_vectors_are_compared_once(spark, monkeypatch, name):
    """The tenth hit and the siblings each had a comparison of all vectors of their own."""
    made, real = [], retrieval.cosine_topk
    monkeypatch.setattr(retrieval, "cosine_topk", lambda *a, **b: made.append(1) or real(*a, **b))
    found = sorted(map(tuple, dq.QUERIES[name](spark, ROOT).collect()), key=str)
    assert len(made) == 1
    held = duckdb.connect()
    held.execute(f"create view embeddings as select * from '{ROOT}/embeddings.parquet'")
    want = held.execute(dq.ORACLE_SQL[name]).fetchall()
    assert [(r[0], *r[1:]) for r in found] == sorted(want, key=str)


@pytest.mark.parametrize("name", ["eval_top_competing", "eval_rank_details", "eval_recall_mrr"])
def test_hits_that_meet_their_own_expected_are_made_once(spark, name):
    """Both sides of the join compared all vectors; now neither does, as the hits are a table."""
    found = eq.QUERIES[name](spark, ROOT)
    rows = found.collect()
    assert rows and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
