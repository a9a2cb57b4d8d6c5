"""Audits of documents, pages, trees and chunks on small literals."""

from pyspark.sql import functions as F

from quarryspark.functions import urls
from quarryspark.operators import document_audit as da
from quarryspark.operators import knowledge

PAGES = "document_id string, position int, page_number int, text string, by_ocr boolean, confidence double"


def issues(rows):
    return {(r["document_id"], r["issue"]): (r["severity"], r["n"]) for r in rows.collect()}


def test_pages_in_order_have_no_issues(spark):
    long = "words " * 20
    rows = spark.createDataFrame([("a", 0, 1, long, True, 90.0), ("a", 1, 2, long, True, None), ("b", 0, 1, long, False, None), ("c", 0, None, long, False, None)], PAGES)
    assert da.page_issues(rows).count() == 0 and da.page_issues(rows.limit(0)).count() == 0


def test_pages_out_of_order_missing_repeated_and_badly_read(spark):
    long = "words " * 20
    rows = [("a", 0, 3, long, False, None), ("a", 1, 1, long, False, None), ("a", 2, 1, None, False, None), ("a", 3, 0, long, False, None), ("b", 0, 1, "short", True, None), ("b", 1, 2, long + "| | |", True, None), ("c", 0, 1, long, True, 20.0)]
    found = da.page_issues(spark.createDataFrame(rows, PAGES))
    assert issues(found) == {
        ("a", "pages out of order"): ("CRITICAL", 2), ("a", "missing pages"): ("CRITICAL", 1), ("a", "duplicate page numbers"): ("WARNING", 1), ("a", "empty page"): ("WARNING", 1), ("a", "invalid page number"): ("WARNING", 1),
        ("b", "unusually short page"): ("WARNING", 1), ("b", "suspicious OCR characters"): ("WARNING", 1), ("b", "missing OCR metadata"): ("INFO", 2), ("c", "low OCR confidence"): ("WARNING", 1),
    }
    first = {(r["document_id"], r["issue"]): r["first"] for r in found.collect()}
    assert first["a", "pages out of order"] == 0 and first["a", "duplicate page numbers"] == 1 and first["a", "missing pages"] is None


def test_pages_meet_without_windows(spark):
    plan = da.page_issues(spark.createDataFrame([("a", 0, 1, "x", False, None)], PAGES))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_structure(spark):
    rows = [("a", 0, "heading", "Part"), ("a", 1, "paragraph", "x" * 6000), ("a", 2, "heading", "part"), ("b", 0, "table", "| a |\n|---|"), ("b", 1, "table", "|---|"), ("b", 2, "list", " "), ("b", 3, "paragraph", None), ("b", 4, "heading", ""), ("c", 0, "table", "| a |\n|--|\n| b |")]
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "document_id string")
    found = da.structure_issues(docs, spark.createDataFrame(rows, "document_id string, ord int, node_type string, text string"))
    assert {k: n for k, (_, n) in issues(found).items()} == {
        ("a", "giant paragraph"): 1, ("a", "single giant paragraph structure"): 1, ("a", "duplicated section headings"): 1, ("b", "table with headers but no rows"): 1, ("b", "empty table"): 1, ("b", "empty list"): 1,
        ("b", "empty paragraph"): 1, ("b", "empty section"): 1, ("d", "document has no structured children"): 1,
    }


def test_integrity_and_verdicts(spark):
    schema = "document_id string, website string, policy string, canonical_url string, source_url string, source_type string, extraction_method string, processing_status string, version int, is_current boolean, content_hash string, title string, text string, excluded boolean, exclusion_reason string"
    url = "https://a.example/p"
    good = ("id", "a.example", "TARGET", url, url, "html", "html_parser", "ACTIVE", 1, True, "sha256:0", "T", "x", False, None)
    rows = spark.createDataFrame([good, good[:7] + ("EXCLUDED", 1, False, "sha256:0", None, None, None, None), (None,) * 15], schema).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("document_id", F.when(F.col("document_id").isNotNull(), urls.document_id(F.col("website"), F.col("canonical_url"))))
    found = rows.select(F.col("row").alias("document_id"), F.explode(da.integrity()).alias("i")).select("document_id", "i.issue", "i.severity")
    by = {}
    for r in found.collect():
        by.setdefault(r["document_id"], set()).add(r["issue"])
    order = [r["row"] for r in rows.orderBy("row").collect()]
    assert by == {
        order[1]: {"EXCLUDED status but excluded flag not set", "EXCLUDED status missing exclusion_reason"},
        order[2]: {"missing document_id", "missing canonical_url", "missing source_url", "invalid source_type", "invalid extraction_method", "invalid version number", "invalid content_hash"},
    }
    passed = {r["document_id"]: (r["errors"], r["passed"]) for r in da.verdicts(rows.select(F.col("row").alias("document_id")), found).collect()}
    assert passed == {order[0]: (0, True), order[1]: (2, False), order[2]: (7, False)}


def test_chunks_of_a_set(spark):
    schema = "document_id string, chunk_index int, chunk_id string, content string, token_count long, path array<string>, content_type string, file_hash string, version string, input_hash string, expected_hash string"
    ok = ("table", "f", "v", "h", "h")
    good = "A whole sentence with more than a handful of words in it, which stands alone."
    rows = [
        ("d", 0, "c0", good, 20, ["A"], "text", *ok[1:]), ("d", 1, "c1", good.upper(), 20, ["A"], "text", *ok[1:]), ("d", 2, "c2", f" {good} ", 20, ["B"], "text", *ok[1:]), ("e", 0, "c0", good, 20, ["FAQ"], "text", *ok[1:]),
        ("e", 1, "c4", "Page 1 of 2", 3, ["A"], *ok), ("e", 2, None, None, 0, None, "text", None, None, None, "h"), ("e", 3, "c6", "When is it due? Is it?", 600, ["A"], "text", *ok[1:]),
    ]
    rows = spark.createDataFrame(rows, schema)
    got = sorted((r["document_id"], r["chunk_index"], r["category"]) for r in da.chunk_audit(rows).collect())
    assert got == sorted([
        ("d", 1, "duplicate_same_context"), ("d", 1, "duplicate_same_context"), ("d", 2, "duplicate_same_context"), ("e", 0, "duplicate_chunk_id"), ("e", 0, "faq_answer_only"),
        ("e", 1, "heading_only"), ("e", 1, "page_counter"), ("e", 1, "broken_table"), ("e", 2, "orphan_tail"), ("e", 2, "heading_only"), ("e", 2, "missing_provenance"), ("e", 2, "missing_provenance"), ("e", 2, "nondeterministic_embedding_input"),
        ("e", 3, "max_token_violation"),
    ])
    assert da.chunk_audit(rows.limit(0)).count() == 0
    assert da.chunk_audit(rows, broken=F.contains("content", F.lit("due?"))).where("category = 'broken_specification'").count() == 1


def test_questions_in_their_scope(spark):
    chunks = spark.createDataFrame([
        ("c1", "a", "faq", "ocr", None, "Red and blue", True), ("c2", "a", "faq", "native", 4, "blue GREEN", True), ("c3", "b", "policy", "native", 5, "red green", False), ("c4", "b", "policy", "native", None, None, True), ("c5", "b", "faq", "native", 1, "red, green, blue", True),
    ], "chunk_id string, document_id string, document_type string, extraction_method string, page_number int, content string, served boolean")
    asked = [
        (1, "a", None, None, ["RED", "green"], False, False), (2, "a", None, None, ["red", "green"], True, False), (3, "b", "faq", "ocr", ["blue"], True, True), (4, "b", "policy", None, ["red"], False, False),
        (5, None, None, None, ["green", "red", "green"], True, True), (6, None, None, None, [], False, False), (7, None, None, None, ["nowhere"], False, False), (8, "a", None, "native", ["blue", ""], True, True),
    ]
    questions = spark.createDataFrame(asked, "query_id int, document_id string, document_type string, extraction_method string, needles array<string>, one_chunk boolean, need_page boolean")
    got = {r["query_id"]: tuple(r)[1:] for r in knowledge.scoped_coverage(questions, chunks).collect()}
    assert got == {
        1: (2, True, False, [], True, False, False, True), 2: (2, True, False, [], True, False, True, False),  # together, not in one
        3: (1, True, True, ["c1"], False, False, False, False),  # the type stands in place of the document; no page
        4: (1, False, False, [], True, True, False, False),  # under review only
        5: (2, True, True, ["c5"], True, False, False, True), 6: (0, True, False, [], True, False, False, True), 7: (1, False, False, [], True, False, False, False), 8: (1, True, True, ["c2"], True, False, False, True),
    }
