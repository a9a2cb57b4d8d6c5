"""Decisions, diagnosis and traces on literals, and against plain Python where SQL has no words for a rule."""

import json
import re

from pyspark.sql import functions as F

from quarryspark.operators import decisions, diagnosis, traces

GARBAGE = re.compile(r"(.)\1{4,}|[^a-zA-Z0-9\s.,;:!?()\-–—/₹$%@&'\"]{3,}")
TEXTS = [
    None, "", "  \n", "aaaaa bbbbb ccccc", "###### ===== *** ok words here", "a b c d e f", "plain words of a plain text. " * 20, "x1 2 3 4 5 6 7 8 9 0 " * 30, "12 34\n56 78\n90 12\n34 56\n78 90\nwords in a line", "ééééé ßßß §§§ ~~~", "§§§§§§§ +++ === {{{", "zzzzz" * 8,
]


def grade(text):
    text = text or ""
    n = len(GARBAGE.findall(text))
    if not text.strip() or n >= 6:
        return "UNUSABLE"
    if n:
        return "SUBSTANTIAL" if n >= 4 else "MINOR"
    return "UNUSABLE" if len(text) > 400 and len(re.findall("[A-Za-z]{3,}", text)) < 25 else "GOOD"


def shares(text):
    return [sum(c.isalpha() for c in s) / len(s) for line in (text or "").splitlines() if (s := line.strip())]


def concern(text):
    if not (text or "").strip():
        return False
    words = re.findall("[A-Za-z]{2,}", text)
    return len(GARBAGE.findall(text)) >= 2 or not words or sum(len(w) == 2 for w in words) / len(words) > 0.25 or sum(x < 0.45 for x in shares(text)) >= 3


def corrupted(text):
    few = len(text or "") > 400 and len(re.findall("[A-Za-z]{3,}", text)) < 25
    return bool((text or "").strip()) and (len(GARBAGE.findall(text)) >= 3 or sum(x < 0.35 for x in shares(text)) >= 5 or few)


def test_ocr_grades_against_python(spark):
    t = F.col("t")
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", decisions.ocr_grade(t), decisions.ocr_concern(t), decisions.ocr_corrupted(t)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {i: (grade(x), concern(x), corrupted(x)) for i, x in enumerate(TEXTS)}


def test_document_types(spark):
    rows = [
        ("https://a.b/products/x", "", "html", "product"), ("https://a.b/pages/refund-policy", "", "html", "policy"), ("https://a.b/x", "Privacy Policy", "html", "policy"), ("https://a.b/faq", "", "html", "faq"), ("https://a.b/blog/1", "", "html", "blog"),
        ("https://a.b/investor/notices/1.pdf", "", "pdf", "notice"), ("https://a.b/investor/1.pdf", "", "pdf", "investor"), ("https://a.b/model9.pdf", "", "pdf", "product"), ("https://a.b/1.pdf", "", "pdf", "other"), ("https://a.b/", "", "html", "webpage"), ("https://a.b/", "", "x", "other"),
    ]
    df = spark.createDataFrame(rows, "u string, t string, s string, want string")
    got = df.select("want", decisions.document_type(F.col("u"), F.col("t"), F.col("s"), F.lit(False), product_words=("model9",)).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_chunk_issues_and_rejections(spark):
    df = spark.createDataFrame([("", 0, "d"), ("Add to cart", 3, None), ("good words in a chunk_id: line", 600, "d"), ("%%", 1, "d")], "c string, n int, d string")
    got = [r[0] for r in df.select(decisions.chunk_issues(F.col("c"), F.col("n"), document_id=F.col("d"))).collect()]
    assert got == [["empty_content", "invalid_token_count", "ocr_garbage"], ["missing_document_id", "ui_debris"], ["token_limit_exceeded", "forbidden_metadata_leakage"], ["ocr_garbage"]]
    s = spark.createDataFrame([("EMBED_READY",), ("REVIEW",), (None,)], "s string").select(decisions.embeddable(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in s] == [None, "REVIEW chunk rejected", "invalid eligibility status"]


def test_all_expected_are_required(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 4), (2, "a", 1), (3, "x", 1)], "query_id int, chunk_id string, rank int")
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "z"), (1, "a")], "query_id int, chunk_id string")
    got = {r["query_id"]: r for r in diagnosis.recall_of_all(diagnosis.all_ranks(hits, want, spark.createDataFrame([(1,), (2,), (3,)], "query_id int"))).collect()}
    assert (got[1]["rank"], got[1]["recall_at_3"], got[1]["recall_at_5"], got[1]["reciprocal_rank"]) == (4, 0.0, 1.0, 0.25)
    assert (got[2]["n_found"], got[2]["rank"], got[2]["reciprocal_rank"]) == (1, None, 0.0) and (got[3]["n_expected"], got[3]["recall_at_10"]) == (0, 0.0)


def test_representatives_prefer_other_products(spark):
    rows = [("k", c, "TOOL_FAILURE", p) for c, p in enumerate("aaaaabac")]
    got = diagnosis.representatives(spark.createDataFrame(rows, "g string, c int, f string, p string"), ["g"], "c", "f", "p").orderBy("place").collect()
    assert [r["c"] for r in got] == [0, 1, 2, 5, 7]


def test_regression_needs_every_needle_and_no_leak(spark):
    hits = spark.createDataFrame([(1, 1, "Alpha beta"), (1, 2, "gamma"), (2, 1, "alpha SHA256:00"), (3, 11, "alpha")], "query_id int, rank int, text string")
    needles = spark.createDataFrame([(1, ["ALPHA", "gamma"]), (2, ["alpha"]), (3, ["alpha"]), (4, ["alpha"])], "query_id int, needles array<string>")
    got = {r["query_id"]: (r["n_found"], r["leaked"], r["passed"]) for r in diagnosis.regression(hits, needles).collect()}
    assert got == {1: (2, False, True), 2: (1, True, False), 3: (0, False, False), 4: (0, False, False)}


def test_traces_that_are_broken_or_empty(spark):
    deep = {"turn_understanding": {"needs_rag": True}, "retrieval": {"candidates": [{"chunk_id": "a"}]}, "reranking": {"enabled": True, "candidates": [{"chunk_id": "b"}]}, "final_context": {"chunks": [{"chunk_id": "b", "position": 3, "section": "plain", "score": 0.5}]}}
    rows = traces.parsed(spark.createDataFrame([("x", "no json"), ("e", "{}"), ("n", None), ("d", json.dumps(deep))], "trace_id string, trace string"))
    got = {r["trace_id"]: r["f"] for r in rows.select("trace_id", traces.first_failure(F.col("t")).alias("f")).collect()}
    assert got == {"x": "RESPONSE", "e": "RESPONSE", "n": "RESPONSE", "d": "RERANKER"}
    hits = traces.layer_hits(rows).collect()
    assert [(r["trace_id"], r["layer"], r["rank"], r["section_path"], r["rerank_score"]) for r in hits] == [("d", "reranked", 0, "", None), ("d", "final", 3, "plain", 0.5)]
    assert traces.turn_fields(rows).count() == 4
