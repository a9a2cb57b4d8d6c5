"""Knowledge in blocks and chunks, and the stores, on literals."""

from pyspark.sql import functions as F

from quarryspark.functions import urls
from quarryspark.operators import blocks, knowledge
from quarryspark.sources import store


def test_faq_text(spark):
    text = "# Title\n\n## Is it new?\n\nYes, it is.\n\n## Why?\n- one\n- two\n\nQ1. What? Nothing.\n\nQuestion of mine? An answer.\n\nPlain words.\n\n## And then?"
    docs = spark.createDataFrame([(1, text), (2, "# only"), (3, None)], "doc_id long, text string")
    titles = docs.select(F.col("doc_id").alias("document_id"), F.lit(" the  title ").alias("title"))
    got = {r["document_id"]: r["text"] for r in knowledge.faq_text(blocks.markdown_blocks(docs), titles).collect()}
    assert got[1] == "Question:\nIs it new?\n\nAnswer:\nYes, it is.\n\nQuestion:\nWhy?\n\nAnswer:\n- one\n- two\n\nQuestion:\nQuestion of mine?\n\nAnswer:\nAn answer.\n\nPlain words."
    assert got[2] == got[3] == "the title"


def test_sanitized(spark):
    text = "# Head\nsee [this](https://a.b/c) ![x](y.png)\n- [nav](http://a.b)\nAdd to cart\n\n\n\n sha256:" + "a" * 64 + "\n\nlast"
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(knowledge.sanitized(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == ["Head\nsee this\n\nlast", "", ""]


def test_repeats_and_suppression(spark):
    long = "the same knowledge that is long enough to be told twice"
    rows = [(1, 0, "a", 0, long), (1, 1, "b", 0, long.upper()), (1, 2, "a", 1, long), (1, 3, "a", 1, "SHORT"), (1, 4, "a", 2, "SHORT"), (2, 0, "b", 0, long)]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_index int, label string, path int, content string")
    got = {(r["document_id"], r["chunk_index"]): (r["duplicate_of"], r["class"]) for r in knowledge.document_repeats(chunks).collect()}
    assert got == {(1, 1): (0, "SAME_CONTEXT_DUPLICATE"), (1, 2): (0, "DIFFERENT_CONTEXT_REPEAT"), (1, 4): (3, "DUPLICATE_HEADING")}
    kept = lambda **k: {(r["document_id"], r["chunk_index"]): r["kept"] for r in knowledge.suppressed(chunks, ["b"], **k).collect()}
    assert kept() == {(1, 0): False, (1, 1): True, (1, 2): True, (1, 3): True, (1, 4): True, (2, 0): True}
    assert kept(cross_document=True) == kept() | {(2, 0): False}


def test_question_coverage(spark):
    q = spark.createDataFrame([(1, 7, ["Alpha", "beta"]), (2, 7, ["alpha", "none"]), (3, 9, ["x"]), (4, 7, [])], "query_id long, document_id long, needles array<string>")
    c = spark.createDataFrame([(7, 0, "ALPHA only"), (7, 1, "beta only")], "document_id long, chunk_index int, content string")
    got = {r["query_id"]: (r["n_held"], r["single_chunk"], r["covered"]) for r in knowledge.question_coverage(q, c).collect()}
    assert got[1] == (2, False, True) and got[2] == (1, False, False) and got[3] == (0, False, False) and got[4][0] == 0


def test_scope_of_a_question(spark):
    rows = spark.createDataFrame([(1, "faq", "ocr"), (2, "faq", "text"), (1, "blog", "text")], "document_id long, document_type string, extraction_method string")
    n = lambda d, t, m: rows.where(knowledge.scoped(F.lit(d).cast("long"), F.lit(t).cast("string"), F.lit(m).cast("string"))).count()
    assert (n(1, None, None), n(1, "faq", None), n(1, "faq", "ocr"), n(None, None, None)) == (2, 2, 1, 3)


def test_store_changes(spark):
    rows = spark.createDataFrame([(1, "open"), (2, "open"), (3, None)], "id int, status string")
    changes = spark.createDataFrame([(1, "closed", 5), (1, "open", 4), (3, "open", 1)], "id int, status string, changed_by int")
    got = {r["id"]: (r["status"], r["changed"]) for r in store.with_status(rows, changes, "id").collect()}
    assert got == {1: ("closed", True), 2: ("open", False), 3: ("open", False)}
    here = {r["id"]: (r["n"], r["exists"]) for r in store.present(rows, spark.createDataFrame([(1,), (9,), (1,)], "id int"), ["id"]).collect()}
    assert here == {1: (1, True), 9: (0, False)}
    assert {r["id"] for r in store.without(rows, rows.where("id = 2"), "id").collect()} == {1, 3}
    a, b = (store.corpus_manifest(rows.repartition(k).select(F.lit("g").alias("g"), "id", F.coalesce("status", F.lit("")).alias("t")), "g", "id", "t").first() for k in (1, 3))
    assert a == b and a["n"] == 3


def test_slugs(spark):
    got = spark.createDataFrame([("https://www.a-b.example/x",), ("no url",), ("http://ü.b:80/",)], "u string").select(urls.slug(F.col("u")).alias("s")).collect()
    assert [r["s"] for r in got] == ["a-b.example", "crawl", "b-80"] or got[2]["s"] in (".b-80", "b-80")
