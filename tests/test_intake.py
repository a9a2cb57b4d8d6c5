"""Regions, answers, uploads, older records and extractions on small literals."""

import json

from pyspark.sql import functions as F

from quarryspark.operators import intake


def test_regions(spark):
    said = {"in": ("IN", "IN"), " U.S.A. ": ("US", "US"), "united  kingdom!": ("GB", "GB"), "Usain": (None, None), "from Great Britain, once": (None, "GB"), "an indian in America": (None, "US"), "indiana": (None, None), "": (None, None), None: (None, None)}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", intake.region(F.col("t")).alias("a"), intake.region_named(F.col("t")).alias("b"))
    assert {r["t"]: (r["a"], r["b"]) for r in rows.collect()} == said


def test_answers_and_their_sources(spark):
    allowed = ["abc", "abd", "x"]
    cases = [
        (None, "invalid_json", [], [], []), ("{", "invalid_json", [], [], []), ("[1]", "invalid_json", [], [], []), ('"text"', "invalid_json", [], [], []), ("{}", "invalid_answer", [], [], []), (json.dumps({"answer": 5}), "invalid_answer", [], [], []),
        (json.dumps({"answer": " ", "source_ids": ["x"]}), "invalid_answer", [], [], []), (json.dumps({"answer": "a", "source_ids": "[SOURCE_ID: abc]"}), "ok", ["abc"], ["abc"], []),
        (json.dumps({"answer": "a", "source_ids": ["ab", " ", "x9", "x", "x", "y"]}), "ok", ["ab", "x9", "x", "y"], ["x"], ["ab", "x9", "y"]), (json.dumps({"answer": "a", "source_ids": {"x": 1}}), "ok", [], [], []),
    ]
    rows = spark.createDataFrame([(k, c[0], allowed) for k, c in enumerate(cases)], "k int, p string, a array<string>").select("k", "a", intake.explained(F.col("p"), F.col("a")).alias("e"))
    got = rows.select("k", "e.*", intake.answer_sources(F.col("e"), F.col("a")).alias("s")).orderBy("k").collect()
    assert [(r["reason"], r["returned"], r["valid"], r["invalid"]) for r in got] == [c[1:] for c in cases]
    assert [r["s"] for r in got] == [None] * 7 + [["abc"], ["x"], ["abc", "abd", "x"]]


def test_uploads(spark):
    files = [("a.pdf", 10, None), ("b/A.DOCX", 5, "application/zip"), ("a.pdf", 0, None), ("a.pdf", 11, None), ("a.txt", 1, None), ("d.pdf/a", 1, None), (".pdf", 1, None), (None, 1, None), ("a.pdf", None, None), ("a.doc", 1, "text/plain")]
    rows = spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "k int, n string, s long, m string")
    got = [r["i"] for r in rows.select("k", intake.upload_issue(F.col("n"), F.col("s"), 10, F.col("m")).alias("i")).orderBy("k").collect()]
    assert got == [None, None, "file is empty", "file exceeds size limit", *["unsupported extension"] * 3, "file not found", "file not found", "mime type mismatch"]


def test_older_records(spark):
    given = [("https://www.a.example/x/?ref=1", "T", "c", None), ("https://a.example/p.PDF", "T [OCR]", None, None), ("https://a.example/p.pdf", "", "c", ""), ("https://a.example/p.pdf", None, "c", "Html"), (None, None, None, None)]
    rows = spark.createDataFrame([(k, *g) for k, g in enumerate(given)], "k int, u string, t string, c string, y string").select("k", intake.legacy_record(*map(F.col, "utcy")).alias("r"))
    got = [(r["website"], r["title"], r["source_type"], r["extraction_method"]) for r in rows.select("k", "r.*").orderBy("k").collect()]
    assert got == [("a.example", "T", "html", "html_parser"), ("a.example", "T [OCR]", "scanned_pdf", "ocr"), ("a.example", "https://a.example/p.pdf", "pdf", "pdf_text"), ("a.example", "https://a.example/p.pdf", "html", "html_parser"), ("", "", "pdf", "pdf_text")]


def test_best_extractions(spark):
    rows = spark.createDataFrame([("a", 1, 10, 2, 0.5, "x"), ("a", 2, 10, 3, 0.1, "y"), ("a", 3, 10, 3, 0.1, "z"), ("b", 4, None, 1, 1.0, "n"), ("b", 5, 0, 0, None, "m"), (None, 6, 1, 1, 1.0, "k")], "key string, id int, characters long, words long, score double, tool string")
    assert sorted((r["id"], r["tool"]) for r in intake.best_extractions(rows, "key", "id").collect()) == [(2, "y"), (5, "m"), (6, "k")]
    assert intake.best_extractions(rows.limit(0), "key", "id").count() == 0
