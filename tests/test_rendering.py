"""Rendered documents and lexical coverage on small literals."""

import pytest
from pyspark.sql import functions as F

from quarryspark.functions import text as tx
from quarryspark.operators import rendering

BLOCKS = "document_id string, ord int, node_type string, level int, text string, page int"


def texts(rows):
    return {r["document_id"]: r["text"] for r in rows.collect()}


def test_documents_by_type(spark):
    docs = spark.createDataFrame([
        ("pol", " Return  policy ", None, "policy", "html"), ("prod", "Radio.pdf", "https://a.example/products/m16x-radio/", "product", "html"), ("name", "Radio.pdf", None, "product", "pdf"), ("pdf", "Paper", None, "other", "pdf"),
        ("web", "Page", None, None, "html"), ("faq", "Questions", None, "faq", "html"), ("none", "Nothing", None, "webpage", None),
    ], "document_id string, title string, url string, document_type string, source_type string")
    rows = [
        ("pol", 0, "heading", 1, "return", None), ("pol", 1, "heading", 2, "Costs", None), ("pol", 2, "heading", 2, "cost", None), ("pol", 3, "paragraph", None, "Costs are paid", None), ("pol", 4, "heading", 2, "costs", None), ("pol", 5, "heading", 2, "paid", None),
        ("pol", 6, "heading", 2, "Time", None), ("pol", 7, "heading", 3, "Time", None), ("pol", 8, "heading", 1, "", None), ("pol", 9, "list", None, "a\n \nb ", None),
        ("prod", 0, "heading", 1, "Facts", 1), ("prod", 1, "heading", 1, "Facts", 1), ("prod", 2, "table", None, "| a | b |\n|---|:---|\n|c||", 2), ("name", 0, "paragraph", None, None, None),
        ("pdf", 0, "heading", 1, "One", 1), ("pdf", 1, "paragraph", None, "text", 1), ("pdf", 2, "heading", 2, "One", 1), ("pdf", 3, "heading", 1, "One", 2),
        ("web", 0, "heading", 1, "A", None), ("web", 1, "heading", 1, "A", None), ("web", 2, "heading", 1, "B", None), ("web", 3, "heading", 1, "A", None), ("faq", 0, "heading", 2, "Why?", None), ("faq", 1, "paragraph", None, "So.", None),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    assert texts(rendering.rendered(docs, blocks)) == {
        "pol": "Return policy\n\nCosts\n\nCosts are paid\n\nTime\n\nTime\n\n- a\n- b", "prod": "Product:\nM16X Radio\n\nPage 1\n\nFacts\n\nFacts\n\nPage 2\n\na | b\nc", "name": "Product:\nRadio",
        "pdf": "Document:\nPaper\n\nPage:\n1\n\nOne\n\ntext\n\nPage:\n2\n\nOne", "web": "Page\n\nA\n\nB\n\nA", "faq": "Question:\nWhy?\n\nAnswer:\nSo.", "none": "Nothing",
    }
    assert rendering.rendered(docs.limit(0), blocks).count() == 0
    assert set(texts(rendering.rendered(docs, blocks.limit(0))).values()) == {"Return policy", "Product:\nM16X Radio", "Product:\nRadio", "Document:\nPaper", "Page", "Questions", "Nothing"}


def test_preview_takes_each_item_and_line_apart(spark):
    rows = [("d", 1, "list", None, "a\n\nb", None), ("d", 0, "heading", 1, "H", None), ("d", 2, "table", None, "|x|y|\n|z|", None), ("e", 0, "paragraph", None, " ", None), ("e", 1, "list", None, None, None)]
    assert texts(rendering.preview(spark.createDataFrame(rows, BLOCKS))) == {"d": "H\n\na\n\nb\n\nx | y\n\nz"}


@pytest.mark.parametrize(("query", "text", "codes", "want"), [
    ("what is the price", "Cost: 5", (), 1.0), ("the", "the", (), 0.0), (None, "x", (), 0.0), ("red red blue", "Red", (), 0.5), ("aBTE hearing", "a bte aid", ("bte", "ric"), 0.5), ("aBTE hearing", "a bte aid", (), 0.0), ("red", None, (), 0.0),
])
def test_lexical_coverage(spark, query, text, codes, want):
    row = spark.createDataFrame([(query, text)], "q string, t string").select(tx.lexical_coverage(F.col("q"), F.col("t"), codes).alias("s")).first()
    assert row["s"] == want
