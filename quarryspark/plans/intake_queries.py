"""Registered queries of what comes in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import intake
from ..sources.tables import table
from .corpus_queries import _U, _W

MOST = 20_000


def named_regions(spark, root):
    """Suppliers as people who say where they are, each in one of five ways."""
    k, name = F.col("s_suppkey"), F.col("n_name")
    said = F.when(k % 5 == 0, name).when(k % 5 == 1, F.concat(F.lit(" "), F.lower(name), F.lit("!"))).when(k % 5 == 2, F.left(name, F.lit(3))).when(k % 5 == 3, F.concat(F.lit("I write from "), name, F.lit(" or Indiana"))).otherwise("u.k.")
    rows = table(spark, root, "supplier").join(table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(k, said.alias("said"))
    return rows.select("s_suppkey", intake.region(F.col("said")).alias("region"), intake.region_named(F.col("said")).alias("named"))


def explained_answers(spark, root):
    """Customers as answers in JSON: good ones, blank ones, numbers, lists, single ids, and what is no object."""
    k = F.col("c_custkey")
    key = k.cast("string")
    ids = F.when(k % 4 == 0, F.concat(F.lit('"[SOURCE_ID: c'), key, F.lit(']"'))).when(k % 4 == 1, F.concat(F.lit('["d'), key, F.lit('#2", "x", "d'), key, F.lit('#2", " "]'))).when(k % 4 == 2, F.concat(F.lit('["source_id: c'), key, F.lit('"]'))).otherwise("7")
    answer = F.when(k % 7 == 0, '" "').when(k % 7 == 1, "12").when(k % 7 == 2, "null").otherwise(F.concat(F.lit('"'), F.col("c_name"), F.lit('"')))
    payload = F.when(k % 11 == 0, F.concat(F.lit("["), answer, F.lit("]"))).when(k % 11 == 1, "{no json").when(k % 11 == 2, None).otherwise(F.concat(F.lit('{"answer": '), answer, F.lit(', "source_ids": '), ids, F.lit("}")))
    allowed = F.array(F.concat(F.lit("c"), key), F.concat(F.lit("d"), key))
    rows = table(spark, root, "customer").select(k, allowed.alias("allowed"), intake.explained(payload, allowed).alias("e"))
    join = lambda c: F.array_join(c, "|")
    return rows.select("c_custkey", "e.reason", join("e.returned").alias("returned"), join("e.valid").alias("valid"), join("e.invalid").alias("invalid"), join(intake.answer_sources(F.col("e"), F.col("allowed"))).alias("sources"))


def upload_checks(spark, root):
    k = F.col("page_id")
    name = F.when(k % 13 == 0, None).otherwise(F.concat(F.lit("v1.2/file"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".DOC", ".docx", ".txt", "", ".tar.pdf"))), (k % 6 + 1).cast("int"))))
    mime = F.element_at(F.array(*map(F.lit, ("application/pdf", "text/plain", "application/zip"))), (k % 5 + 1).cast("int") % 3 + 1)
    size = F.when(k % 9 == 0, 0).otherwise(F.length("html"))
    return table(spark, root, "pages").select("page_id", F.coalesce(intake.upload_issue(name, size, MOST, F.when(k % 4 != 0, mime)), F.lit("ok")).alias("issue"))


def legacy_records(spark, root):
    k = F.col("page_id")
    title = F.concat(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.when(k % 3 == 0, " [OCR]").otherwise(""))
    url = F.when(k % 4 == 1, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/a.PDF"))).otherwise(F.col("url"))
    rows = table(spark, root, "pages").select("page_id", intake.legacy_record(url, F.when(k % 8 != 5, title), F.col("html"), F.when(k % 16 == 1, "HTML")).alias("r"))
    return rows.select("page_id", "r.website", F.sha2("r.title", 256).alias("title_sha256"), "r.source_type", "r.extraction_method", "r.content_hash")


def best_extractions(spark, root):
    """Documents as extractions of some hundred papers; of equal lengths, words decide, then the score, then the order."""
    i = F.col("doc_id")
    rows = table(spark, root, "documents").select((i % 97).alias("paper"), i, (F.floor(F.length(tx.filled(F.col("text"))) / 400)).alias("characters"), (tx.word_count(F.col("text")) % 3).alias("words"), (i % 5).cast("double").alias("score"), "lang")
    return intake.best_extractions(rows, "paper", "doc_id")


QUERIES = {"named_regions": named_regions, "explained_answers": explained_answers, "upload_checks": upload_checks, "legacy_records": legacy_records, "best_extractions": best_extractions}

_case = lambda key, values: f"CASE {key} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in values.items()) + " END"
ORACLE_SQL = {
    "named_regions": "WITH s AS (SELECT s_suppkey, upper(CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN ' ' || n_name || '!' WHEN 2 THEN left(n_name, 3) WHEN 3 THEN 'I write from ' || n_name || ' or Indiana' ELSE 'u.k.' END) AS said FROM supplier JOIN nation ON s_nationkey = n_nationkey), "
    + f"r AS (SELECT *, coalesce({_case("regexp_replace(said, '[^A-Z]', '', 'g')", intake.REGION_CODES)}, {_case("trim(regexp_replace(regexp_replace(said, '[^A-Z ]', '', 'g'), ' +', ' ', 'g'))", intake.REGION_NAMES)}) AS region FROM s) "
    + "SELECT s_suppkey, region, coalesce(region, CASE " + " ".join(f"WHEN regexp_matches(said, '\\b{n}\\b') THEN '{intake.REGION_NAMES[n]}'" for n in sorted(intake.REGION_NAMES, key=lambda n: -len(n))) + " END) AS named FROM r",
    "explained_answers": """WITH a AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS s, c_custkey % 11 > 2 AS whole, c_custkey % 7 > 2 AS answer FROM customer),
r AS (SELECT *, CASE WHEN NOT whole THEN 'invalid_json' WHEN NOT answer THEN 'invalid_answer' ELSE 'ok' END AS reason, whole AND answer AS ok, k % 4 AS m FROM a)
SELECT k AS c_custkey, reason, CASE WHEN NOT ok OR m = 3 THEN '' WHEN m = 1 THEN 'd' || s || '#2|x' ELSE 'c' || s END AS returned, CASE WHEN NOT ok OR m = 3 THEN '' WHEN m = 1 THEN 'd' || s ELSE 'c' || s END AS valid,
  CASE WHEN ok AND m = 1 THEN 'd' || s || '#2|x' ELSE '' END AS invalid, CASE WHEN NOT ok THEN NULL WHEN m = 1 THEN 'd' || s WHEN m = 3 THEN 'c' || s || '|d' || s ELSE 'c' || s END AS sources FROM r""",
    "upload_checks": f"""WITH p AS (SELECT page_id, page_id % 6 AS e, CASE WHEN page_id % 9 = 0 THEN 0 ELSE length(html) END AS size, CASE WHEN page_id % 4 <> 0 THEN ['application/pdf', 'text/plain', 'application/zip'][(page_id % 5 + 1) % 3 + 1] END AS mime FROM pages)
SELECT page_id, CASE WHEN page_id % 13 = 0 OR size IS NULL THEN 'file not found' WHEN e IN (3, 4) THEN 'unsupported extension' WHEN size = 0 THEN 'file is empty' WHEN size > {MOST} THEN 'file exceeds size limit' WHEN mime = 'text/plain' THEN 'mime type mismatch' ELSE 'ok' END AS issue FROM p""",
    "legacy_records": _U + r""", t AS (SELECT page_id, CASE WHEN page_id % 4 = 1 THEN regexp_replace(pages.url, '[?#].*$', '') || '/a.PDF' ELSE pages.url END AS url, website, html, regexp_extract(html, '<title>(.*?)</title>', 1, 's') || CASE WHEN page_id % 3 = 0 THEN ' [OCR]' ELSE '' END AS title FROM u JOIN pages USING (page_id)),
h AS (SELECT *, page_id % 16 = 1 OR NOT ends_with(lower(url), '.pdf') AS page, page_id % 8 <> 5 AND page_id % 3 = 0 AS ocr, CASE WHEN page_id % 8 <> 5 AND title <> '' THEN title ELSE url END AS shown FROM t)
SELECT page_id, website, sha256(shown) AS title_sha256, CASE WHEN page THEN 'html' WHEN ocr THEN 'scanned_pdf' ELSE 'pdf' END AS source_type, CASE WHEN page THEN 'html_parser' WHEN ocr THEN 'ocr' ELSE 'pdf_text' END AS extraction_method, 'sha256:' || sha256(coalesce(html, '')) AS content_hash FROM h""",
    "best_extractions": "WITH e AS (SELECT doc_id % 97 AS paper, doc_id, length(coalesce(text, '')) // 400 AS characters, (" + _W.format("coalesce(text, '')") + ") % 3 AS words, (doc_id % 5)::DOUBLE AS score, lang FROM documents) SELECT paper, doc_id, characters, words, score, lang FROM e QUALIFY row_number() OVER (PARTITION BY paper ORDER BY characters DESC, words DESC, score DESC, doc_id) = 1",
}
