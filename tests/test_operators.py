"""Corpus, chunking, evaluation, history and store operators on literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryspark.operators import chunking, corpus, evaluation, history
from quarryspark.sources import store


def test_packing_and_repair():
    assert chunking.packed(["aaaa", "bbbb", "cccc"], 2) == ["aaaa", "bbbb", "cccc"]
    assert chunking.packed(["aa", "bb", "cc", "dd"], 2) == ["aa bb cc", "dd"]
    parts = chunking.split_to_budget(" ".join(f"word{i}" for i in range(60)), 20, 10)
    assert " ".join(parts).split() == [f"word{i}" for i in range(60)]
    assert all(chunking.estimate(p) <= 20 for p in parts) and chunking.estimate(parts[-1]) >= 10
    assert chunking.split_to_budget("", 20, 10) == []


def test_chunks_are_the_same_when_made_again(spark):
    docs = spark.createDataFrame([(1, "one two three. Four five six " * 30), (2, None), (3, "")], "doc_id long, text string")
    a, b = (sorted(chunking.chunked(docs, 40, 10).collect()) for _ in range(2))
    assert a == b and {r["document_id"] for r in a} == {1} and all(r["token_count"] <= 40 for r in a)


def test_sentences(spark):
    got = spark.createDataFrame([("One. Two? 3 (x) no. end",)], "t string").select(chunking.sentences(F.col("t")).alias("s")).first()["s"]
    assert got == ["One.", "Two?", "3 (x) no. end"]


@pytest.mark.parametrize(("text", "reason"), [("Open media 3 in modal", "shopify_ui_fragment"), ("3 / of 4", "page_counter"), ("- 7", "numeric_list_debris"), ("- ab", "short_list_debris"), ("IV X", "ocr_roman_numeral_debris"), ("IV+", "ocr_roman_numeral_debris"), ("1.2 Clause", None), ("size: 10", None)])
def test_noise(spark, text, reason):
    row = spark.createDataFrame([(text, 2)], "c string, n long").select(corpus.noise(F.col("c"), F.col("n"))["reason"].alias("r")).first()
    assert row["r"] == reason


def test_only_chunks_that_reach_the_rule_count_as_seen(spark):
    rows = [(1, "w", 0, "A sentence that is long enough to stay here.", 11), (1, "w", 1, "a  sentence that is long enough to stay here.", 11), (2, "w", 0, "A sentence that is long enough to stay here.", 11), (1, "w", 2, "", 0), (1, "w", 3, "", 0)]
    got = {(r["document_id"], r["chunk_index"]): r["reason"] for r in corpus.chunk_gate(spark.createDataFrame(rows, "document_id long, website string, chunk_index int, content string, token_count long")).collect()}
    assert got == {(1, 0): None, (1, 1): "duplicate:SAME_CONTEXT_DUPLICATE", (2, 0): None, (1, 2): "empty_content", (1, 3): "empty_content"}


def test_eligibility(spark):
    rows = [("http://a/cart", "t", "x" * 100), ("http://a/b", "Sign in", "x" * 100), ("http://a/b", "t", "x"), ("http://a/b", "t", "[x](http://b) " * 6 + "y" * 60), ("http://a/b", "t", "word " * 100)]
    got = [r["r"] for r in spark.createDataFrame(rows, "u string, t string, x string").select(corpus.page_eligibility(F.col("u"), F.col("t"), F.col("x"))["reason"].alias("r")).collect()]
    assert got == ["CART_CHECKOUT_UI", "ACCOUNT_UI", "INSUFFICIENT_CONTENT", "NAVIGATION_ONLY", None]


def test_apportioned_adds_up(spark):
    w = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "name string, w long")
    assert {r["name"]: r["n"] for r in corpus.apportioned(w, 10, "name", "w").collect()} == {"a": 4, "b": 3, "c": 3}


def test_difference(spark):
    p, c = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, h string"), spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "k long, h string")
    assert {r["k"]: r["state"] for r in corpus.difference(p, c, "k", "h").collect()} == {1: "missing", 2: "same", 3: "modified", 4: "new"}


def test_nearest_rank_rounds_halves_to_even(spark):
    rows = spark.createDataFrame([(float(v), "a") for v in (10, 20, 30, 40, 50)] + [(1.0, "b"), (2.0, "b"), (None, "b")], "v double, g string")
    got = {r["g"]: r for r in evaluation.nearest_rank(rows, "v", (50, 99), "g").collect()}
    assert (got["a"]["p50"], got["a"]["p99"], got["b"]["p50"], got["b"]["n"]) == (30.0, 50.0, 1.0, 2)


def test_metrics_and_comparison(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 11)], "query_id long, rank int")
    row = evaluation.summary(evaluation.measured(ranks)).first()
    assert (row["recall_at_1"], row["recall_at_5"], row["passed"], row["mrr"]) == (0.25, 0.5, 2, 0.3352)
    other = spark.createDataFrame([(1, 2), (2, None), (3, 3), (4, 12)], "query_id long, rank int")
    assert {r["query_id"]: r["change"] for r in evaluation.compared(ranks, other).collect()} == {1: "unchanged", 2: "newly_failed", 3: "newly_passed", 4: "unchanged"}
    assert {r["query_id"]: r["status"] for r in evaluation.rank_change(ranks, other).collect()} == {1: "regressed", 2: "regressed", 3: "unchanged", 4: "regressed"}


def test_clusters_and_zero_fill(spark):
    rows = spark.createDataFrame([("RETRIEVAL_FAILURE", "p", c, pr) for c, pr in ((1, "x"), (1, "y"), (2, "y"), (3, None))], "failure_type string, pattern string, conversation_id long, product string")
    row = evaluation.failure_clusters(rows, 100).first()
    assert (row["n_conversations"], row["n_turns"], row["percentage"], row["common_product"], row["severity"]) == (3, 4, 3.0, "y", 60)
    assert {r["label"]: r["n"] for r in evaluation.zero_filled(rows, "failure_type", ("RETRIEVAL_FAILURE", "OTHER")).collect()} == {"RETRIEVAL_FAILURE": 4, "OTHER": 0}


def ts(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_a_gap_of_just_the_limit_ends_a_session(spark):
    e = spark.createDataFrame([(n, 1, ts(s)) for n, s in enumerate((0, 899, 899 + 900, 5000))], "event_id long, user_id long, ts timestamp")
    assert [r["session"] for r in history.idle_sessions(e, "user_id", "ts").orderBy("event_id").collect()] == [1, 1, 2, 3]


def test_claims_hold_for_their_time(spark):
    e = spark.createDataFrame([(n, "k", ts(s)) for n, s in enumerate((0, 50, 100, 150, 230))], "event_id long, k string, ts timestamp")
    assert sorted(r["event_id"] for r in history.first_claims(e, ["k"], "ts", "event_id", 100).collect()) == [0, 2, 4]


def test_history(spark):
    t = spark.createDataFrame([(1, n, "user", f" {n} " + "x" * 300) for n in range(8)], "conv_id long, turn long, role string, text string")
    assert history.latest_turns(t).first()["turn"] == 7 and history.latest_turns(t).first()["n_turns"] == 8
    got = history.compacted(t).collect()
    assert len(got) == 6 and all(len(r["content"]) == 250 for r in got)


def test_writes_may_be_repeated(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "k long, v string")
    once = store.upserted(a, b, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "z")]
    assert store.new_rows(once, b, ["k"]).count() == 0
    assert sorted(map(tuple, store.upserted(a, b, ["k"], force=True).collect())) == [(1, "y"), (2, "z")]
    v = store.versions(spark.createDataFrame([(1, n, h) for n, h in enumerate("aabba")], "k long, n long, h string"), "k", "n", "h")
    assert [(r["version"], r["is_current"]) for r in v.orderBy("n").collect()] == [(1, False), (1, False), (2, False), (2, False), (3, True)]


def test_nearest_rank_by_sketch_is_exact(spark):
    """Groups above `small` are ranked between the values that a sketch gives: heavy ties, a null group, an outlier."""
    values = [round(((k * 7919) % 10_007) / 10.0, 1) for k in range(10_007)] + [500.0] * 5_000 + [1e9]
    rows = spark.createDataFrame([("a", v) for v in values] + [(None, v) for v in values[:3_000]] + [("b", 2.0), ("b", None)], "g string, v double").repartition(6)
    got = {r["g"]: r for r in evaluation.nearest_rank(rows, "v", (1, 50, 90, 99), "g", small=100).collect()}
    for g, own in (("a", sorted(values)), (None, sorted(values[:3_000])), ("b", [2.0])):
        assert got[g]["n"] == len(own)
        assert [got[g][f"p{p}"] for p in (1, 50, 90, 99)] == [round(own[round(p / 100 * (len(own) - 1))], 3) for p in (1, 50, 90, 99)]


def test_first_of_equal_keys(spark):
    rows = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, None, 2), (4, None, 5), (5, "y", 0)], "i int, k string, o int")
    got = {r["i"]: (r["kept"], r["duplicate_of"]) for r in corpus.kept_first(rows, ["k"], ["o"], "i").collect()}
    assert got == {1: (False, 2), 2: (True, None), 3: (True, None), 4: (False, 3), 5: (True, None)}


def test_gaps_and_repeats(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0), ("b", 1), ("c", 0), ("c", 0), ("c", 1_000_000_000)], "k string, t long")
    from quarryspark.operators import audit

    assert {tuple(r) for r in audit.numbering_gaps(rows, "k", "t").collect()} == {("a", 1, 0), ("c", 999_999_999, 1)}
