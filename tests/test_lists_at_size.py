"""The two lexical lists come from one scan of the corpus each time it is needed, and words are never shuffled."""

import duckdb
import pytest

from quarryspark.operators import retrieval
from quarryspark.plans import evaluation_queries as eq
from quarryspark.plans import retrieval_queries as rq

ROOT = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def small(spark):
    texts = [(1, "red apple red"), (2, "Green pear"), (3, None), (4, ""), (5, "pear apple pear x1"), (6, "red")]
    asked = [(1, "red red apple"), (2, "pear"), (3, "absent"), (4, None), (5, "x1 green RED pear")]
    return spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)


def test_terms_and_sizes_are_counted_in_one_scan(spark):
    """The corpus was tokenised once for the frequencies and once more for its size."""
    found = {r["term"]: (r["df"], r["n_tokens"]) for r in retrieval.term_counts(*small(spark)).collect()}
    assert found == {"": (6, 10), "red": (2, None), "apple": (2, None), "pear": (2, None), "green": (1, None), "x1": (1, None)}
    queries, corpus = small(spark)
    assert retrieval.term_counts(queries, corpus.limit(0)).count() == 0 and retrieval.bm25_topk(queries, corpus.limit(0)).count() == 0


def test_words_are_not_shuffled_whatever_the_threshold(spark):
    """Where a session broadcasts little, all distinct words of all chunks were shuffled to meet the queries' terms."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.term_counts(*small(spark))
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_both_lists_of_one_scan_are_those_of_two(spark, monkeypatch, block):
    queries, corpus = small(spark)
    want = {(n, *r) for n, one in enumerate((retrieval.bm25_topk, retrieval.keyword_topk)) for r in one(queries, corpus, 2).collect()}
    real = retrieval._by_terms
    monkeypatch.setattr(retrieval, "_by_terms", lambda *a: real(*a, block=block))  # lists of several blocks, not equally many
    found = retrieval.lists_topk(queries, corpus, 2)
    assert block == 2 or plan(found).count("MapInArrow") == 1
    assert {(r["list"], r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in found.collect()} == want and len(want) > 8


@pytest.mark.parametrize("module, name", [(rq, "fusion_rank_normalized"), (eq, "eval_rerank_delta"), (rq, "multi_query_union_max")])
def test_queries_scan_once_for_their_lists_and_agree_with_their_sql(spark, monkeypatch, module, name):
    monkeypatch.setattr(rq, "_MADE", {})
    made, real = [], retrieval._by_terms
    monkeypatch.setattr(retrieval, "_by_terms", lambda *a, **b: made.append(1) or real(*a, **b))
    found = module.QUERIES[name](spark, ROOT)
    rows = sorted(map(tuple, found.collect()), key=str)
    assert len(made) == 1
    held = duckdb.connect()
    for t in ("documents", "benchmark"):
        held.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    want = held.execute(f"select {', '.join(found.columns)} from ({module.ORACLE_SQL[name]})").fetchall()
    assert rows == sorted(want, key=str)


def test_words_of_a_candidate_are_not_sorted_once_a_term(spark):
    """Each term of a question took all words of each candidate's text through the window over terms."""
    queries, corpus = small(spark)
    found = retrieval.reranked_by_idf(retrieval.merged(*(one(queries, corpus, 2) for one in (retrieval.bm25_topk, retrieval.keyword_topk))), queries, corpus)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(n for n, line in enumerate(lines) if "Window" in line and "windowspecdefinition(query_id" in line and "term#" in line)
    assert lines[at + 1].count("AS hit") == 1 and ", own#" not in lines[at + 1]
