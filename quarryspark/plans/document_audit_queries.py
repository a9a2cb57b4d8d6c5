"""Registered audits of documents, pages, trees and chunks, and the questions that a corpus must cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import blocks, corpus, decisions, knowledge
from ..operators import document_audit as da
from ..operators.structure import held
from ..sources.tables import table
from .corpus_queries import _CLEAN, _EST, _U, _W
from .decision_queries import SITES
from .structure_queries import _B

LIMITS = da.Limits(giant=1500, many_tiny=3, single=900)
STATES = ("ACTIVE", "VALIDATED", "EXCLUDED", "FAILED", "STRUCTURED")


def _records(spark, root):
    """Pages as records of a document store; every fault that an audit looks for is in some of them."""
    i, none = F.col("page_id"), F.lit(None).cast("string")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (i % n + 1).cast("int"))
    named = held(table(spark, root, "pages"), title=F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), text=tx.tidy(tx.without_markup(F.col("html"))), site=urls.website(F.col("url")), canonical_url=urls.normalised(F.col("url")))
    named = held(named, document_id=F.when(i % 19 == 5, none).when(i % 17 == 3, "x").otherwise(urls.document_id(F.col("site"), F.col("canonical_url"))))
    return named.select(
        "page_id", "document_id", F.when(i % 23 == 7, F.upper("site")).otherwise(F.col("site")).alias("website"), decisions.website_policy(F.col("site"), SITES).alias("policy"), F.when(i % 41 == 2, none).otherwise(F.col("canonical_url")).alias("canonical_url"),
        F.when(i % 29 == 1, "").when(i % 31 == 4, F.concat(F.lit("mailto:"), "site")).otherwise(F.col("url")).alias("source_url"), pick(("html", "pdf", "html", "scanned_pdf", "html", "folder"), 6).alias("source_type"), pick(("html_parser", "ocr", "native", "guess"), 4).alias("extraction_method"),
        pick(STATES, 5).alias("processing_status"), (i % 13).alias("version"), (i % 11 != 0).alias("is_current"), F.when(i % 37 == 0, F.sha2("text", 256)).otherwise(tx.content_hash(F.col("text"))).alias("content_hash"),
        F.when(i % 43 == 0, "").otherwise(F.col("title")).alias("title"), F.when(i % 47 == 1, " ").otherwise(F.col("text")).alias("text"), (i % 3 == 0).alias("excluded"), F.when(i % 2 == 0, "by hand").alias("exclusion_reason"),
    )


def integrity_report(spark, root):
    return _records(spark, root).select("page_id", F.explode(da.integrity()).alias("i")).select("page_id", "i.category", "i.issue", "i.severity")


def integrity_verdicts(spark, root):
    rows = _records(spark, root)
    issues = rows.select(F.col("page_id").alias("document_id"), F.explode(da.integrity()).alias("i")).select("document_id", "i.severity")
    return da.verdicts(rows.select(F.col("page_id").alias("document_id")), issues)


def page_audit(spark, root):
    """Turns of conversations as the pages of papers, every third of which was read by OCR."""
    c, t = F.col("conv_id"), F.col("turn")
    number = F.when((c + t) % 17 == 3, t).when((c + t) % 29 == 4, t + 3).when((c * t) % 53 == 6, None).otherwise(t + 1)
    confidence = F.when((c % 9 != 0) & (t % 4 != 1), ((c + t) % 100).cast("double"))
    text = F.when((c + t) % 37 == 1, "").when((c + t) % 31 == 2, F.concat("text", F.lit(" ....... | | |"))).when((c + t) % 13 == 5, F.left("text", F.lit(40))).otherwise(F.col("text"))
    return da.page_issues(table(spark, root, "conversations").select(c.alias("document_id"), t.alias("position"), number.alias("page_number"), text.alias("text"), (c % 3 == 0).alias("by_ocr"), confidence.alias("confidence")))


def structure_audit(spark, root):
    """Trees of documents, in which some lines are made headings, rows and blanks of lists."""
    i = F.col("doc_id")
    text = F.when(i % 7 == 0, F.concat(F.lit("# Part\n| a | b |\n|---|---|\n\n"), "text", F.lit("\n# part\n|---|"))).when(i % 7 == 1, F.regexp_replace("text", "\\. ", ".\nok\n\n")).otherwise(F.col("text"))
    docs = table(spark, root, "documents").select(i, F.when(i % 101 != 9, text).alias("text"))
    return da.structure_issues(docs.select(i.alias("document_id")), blocks.markdown_blocks(docs), LIMITS)


def chunk_audit(spark, root):
    """Lines as chunks of a set, counted by document and category."""
    lines = corpus.line_chunks(table(spark, root, "documents"))
    k, content = F.col("chunk_index"), F.col("content")
    path = F.array(F.coalesce("website", F.lit("")), F.when(k % 3 == 0, "FAQ").otherwise(F.floor(k / 10).cast("string")))
    content = F.when(k % 19 == 7, "Page 3 of 9").when(k % 19 == 8, "And when is it due?").otherwise(content)
    rows = lines.withColumn("content", content).withColumn("token_count", tx.token_estimate(F.col("content")))
    rows = rows.select("document_id", "chunk_index", F.concat_ws(":", "document_id", F.when(k % 50 == 49, k - 1).otherwise(k)).alias("chunk_id"), "content", "token_count", path.alias("path"), F.when(k % 23 == 4, "table").otherwise("text").alias("content_type"),
        F.col("website").alias("file_hash"), F.when(k % 61 != 8, "v1").alias("version"), F.when(k % 40 == 7, "stale").otherwise("fresh").alias("input_hash"), F.lit("fresh").alias("expected_hash"))
    return da.chunk_audit(rows, 60).groupBy("document_id", "category").agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"))


def scoped_questions(spark, root):
    """Documents as chunks, a sixth of them under review; questions by the first words of seven letters of benchmark items."""
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    served = table(spark, root, "documents").select(
        i.alias("chunk_id"), F.coalesce("source", F.lit("")).alias("document_id"), F.coalesce("lang", F.lit("")).alias("document_type"), F.when(i % 2 == 0, "ocr").otherwise("native").alias("extraction_method"), F.when(i % 4 != 1, i % 7).alias("page_number"),
        F.col("text").alias("content"), (i % 6 != 0).alias("served"),
    )
    k = F.col("item_id")
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)), F.lit(1), (k % 4).cast("int"))
    asked = table(spark, root, "benchmark").select(
        k.alias("query_id"), F.when(k % 3 == 0, F.concat(F.lit("src"), (k % 5).cast("string"))).otherwise(none).alias("document_id"), F.when(k % 4 == 0, "en").otherwise(none).alias("document_type"), F.when(k % 5 == 0, "ocr").otherwise(none).alias("extraction_method"),
        words.alias("needles"), (k % 2 == 1).alias("one_chunk"), (k % 7 < 4).alias("need_page"),
    )
    return knowledge.scoped_coverage(asked, served).withColumn("first_chunks", F.array_join(F.transform("first_chunks", lambda c: c.cast("string")), ","))


QUERIES = {
    "integrity_report": integrity_report, "integrity_verdicts": integrity_verdicts, "page_audit": page_audit, "structure_audit": structure_audit, "chunk_audit": chunk_audit, "scoped_questions": scoped_questions,
}


def _listed(*rules: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {holds} THEN {value} END" for value, holds in rules) + "], lambda v: v IS NOT NULL)"


def _issue(category: str, issue: str, severity: str) -> str:
    return f"{{'category': '{category}', 'issue': '{issue}', 'severity': '{severity}'}}"


_LIVE = "st IN ('ACTIVE', 'VALIDATED')"
_ISSUES = _listed(
    (_issue("identity", "missing document_id", "ERROR"), "id IS NULL"), (_issue("identity", "document_id not stable", "ERROR"), "id IS NOT NULL AND (id = 'x' OR i % 41 = 2)"),
    (_issue("identity", "missing canonical_url", "ERROR"), "i % 41 = 2 OR normalised = ''"), (_issue("identity", "missing source_url", "ERROR"), "i % 29 = 1"), (_issue("identity", "invalid source_url", "ERROR"), "i % 29 <> 1 AND i % 31 = 4"),
    (_issue("identity", "website should be lowercase", "ERROR"), "i % 23 = 7"), (_issue("identity", "invalid source_type", "ERROR"), "i % 6 = 5"), (_issue("identity", "invalid extraction_method", "ERROR"), "i % 4 = 3"),
    (_issue("version", "invalid version number", "ERROR"), "i % 13 = 0"), (_issue("version", "invalid content_hash", "ERROR"), "i % 37 = 0"), (_issue("version", "production document is not marked is_current", "ERROR"), _LIVE + " AND i % 11 = 0"),
    (_issue("domain", "NON_TARGET website cannot be ACTIVE/VALIDATED", "ERROR"), _LIVE + " AND NOT target"), (_issue("exclusion", "excluded document cannot be ACTIVE/VALIDATED", "ERROR"), _LIVE + " AND i % 3 = 0"),
    (_issue("exclusion", "EXCLUDED status but excluded flag not set", "ERROR"), "st = 'EXCLUDED' AND i % 3 <> 0"), (_issue("exclusion", "EXCLUDED status missing exclusion_reason", "ERROR"), "st = 'EXCLUDED' AND i % 2 = 1"),
    (_issue("status", "FAILED target-domain document must be resolved before freeze", "ERROR"), "st = 'FAILED' AND target"), (_issue("content", "missing title", "WARNING"), _LIVE + " AND (i % 43 = 0 OR trim(title) = '')"),
    (_issue("content", "plain_text is empty", "ERROR"), _LIVE + " AND (i % 47 = 1 OR text = '')"), (_issue("ocr", "OCR extraction_method should use scanned_pdf source_type", "WARNING"), _LIVE + " AND i % 4 = 1 AND i % 6 <> 3"),
    (_issue("ocr", "scanned_pdf should use OCR extraction_method", "WARNING"), _LIVE + " AND i % 4 <> 1 AND i % 6 = 3"),
)
_RECORDS = (
    _U + f""", t AS (SELECT page_id AS i, normalised, website IN ({", ".join(f"'{s}'" for s in SITES)}) AS target, ['ACTIVE', 'VALIDATED', 'EXCLUDED', 'FAILED', 'STRUCTURED'][page_id % 5 + 1] AS st, CASE WHEN page_id % 19 = 5 THEN NULL WHEN page_id % 17 = 3 THEN 'x' ELSE 'own' END AS id,
  regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, {_CLEAN} AS text FROM u JOIN pages USING (page_id)), v AS (SELECT i AS page_id, unnest({_ISSUES}) AS x FROM t) """
)
_PAGES = r"""WITH p AS (SELECT conv_id AS d, turn AS pos, CASE WHEN (conv_id + turn) % 17 = 3 THEN turn WHEN (conv_id + turn) % 29 = 4 THEN turn + 3 WHEN (conv_id * turn) % 53 = 6 THEN NULL ELSE turn + 1 END AS n, conv_id % 3 = 0 AS ocr, CASE WHEN conv_id % 9 <> 0 AND turn % 4 <> 1 THEN (conv_id + turn) % 100 END AS sure,
  coalesce(CASE WHEN (conv_id + turn) % 37 = 1 THEN '' WHEN (conv_id + turn) % 31 = 2 THEN text || ' ....... | | |' WHEN (conv_id + turn) % 13 = 5 THEN left(text, 40) ELSE text END, '') AS text FROM conversations),
s AS (SELECT *, lead(n) OVER (PARTITION BY d ORDER BY pos) AS following FROM p), g AS (SELECT d, n, count(*) AS c FROM p WHERE n IS NOT NULL GROUP BY ALL), m AS (SELECT d, sum(c - 1)::BIGINT AS again, max(n) - count(*) FILTER (n >= 1) AS gaps, min(n) FILTER (c > 1) AS twice FROM g GROUP BY d)
SELECT d AS document_id, 'empty page' AS issue, 'WARNING' AS severity, count(*) AS n, min(n) AS first FROM p WHERE text = '' GROUP BY d UNION ALL SELECT d, 'invalid page number', 'WARNING', count(*), min(n) FROM p WHERE n < 1 GROUP BY d
UNION ALL SELECT d, 'unusually short page', 'WARNING', count(*), min(n) FROM p WHERE ocr AND length(text) < 50 GROUP BY d UNION ALL SELECT d, 'low OCR confidence', 'WARNING', count(*), min(n) FROM p WHERE ocr AND sure < 50 GROUP BY d
UNION ALL SELECT d, 'suspicious OCR characters', 'WARNING', count(*), min(n) FROM p WHERE ocr AND regexp_matches(text, '(\|\s*){3,}|\.{4,}') GROUP BY d UNION ALL SELECT d, 'pages out of order', 'CRITICAL', count(*), min(following) FROM s WHERE following < n GROUP BY d
UNION ALL SELECT d, 'duplicate page numbers', 'WARNING', again, twice FROM m WHERE again > 0 UNION ALL SELECT d, 'missing pages', 'CRITICAL', gaps, NULL FROM m WHERE gaps > 0 UNION ALL SELECT d, 'missing OCR metadata', 'INFO', count(*), NULL FROM p WHERE ocr GROUP BY d HAVING count(sure) = 0"""
_TREE = _B.replace("FROM documents)", "FROM edited)").replace("WITH l AS", r"""WITH edited AS (SELECT doc_id, CASE WHEN doc_id % 101 <> 9 THEN CASE WHEN doc_id % 7 = 0 THEN '# Part' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || chr(10) || text || chr(10) || '# part' || chr(10) || '|---|' WHEN doc_id % 7 = 1 THEN replace(text, '. ', '.' || chr(10) || 'ok' || chr(10) || chr(10)) ELSE text END END AS text FROM documents), l AS""", 1)
_STRUCTURE = _TREE + r""", w AS (SELECT document_id, count(*) FILTER (node_type = 'paragraph') AS paragraphs, count(*) FILTER (node_type = 'paragraph' AND trim(text) <> '' AND length(trim(text)) < 20) AS tiny, sum(length(text))::BIGINT AS size FROM b GROUP BY 1),
r AS (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^[\s|:\-]+$'))) AS lines FROM b)
SELECT document_id, CASE WHEN node_type = 'paragraph' THEN 'giant paragraph' WHEN lines = 0 THEN 'empty table' ELSE 'table with headers but no rows' END AS issue, 'WARNING' AS severity, count(*) AS n FROM r WHERE (node_type = 'paragraph' AND length(trim(text)) > 1500) OR (node_type = 'table' AND lines < 2) GROUP BY ALL
UNION ALL SELECT document_id, 'duplicated section headings', 'WARNING', count(*) FROM (SELECT document_id, lower(text) AS head FROM b WHERE node_type = 'heading' GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT document_id, 'single giant paragraph structure', 'WARNING', 1 FROM w WHERE paragraphs = 1 AND size > 900 UNION ALL SELECT document_id, 'excessive tiny paragraphs', 'WARNING', tiny FROM w WHERE tiny > 3
UNION ALL SELECT doc_id, 'document has no structured children', 'WARNING', 1 FROM documents WHERE doc_id NOT IN (SELECT document_id FROM w)"""
_STRIP = r"regexp_replace({}, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"
_CHUNK_RULES = _listed(
    ("'max_token_violation'", "t > 60"), ("'orphan_tail'", "t <= 8 AND w <= 3 AND NOT regexp_matches(own, '[0-9]')"), ("'heading_only'", "t <= 12 AND w <= 6"), ("'page_counter'", "k % 19 = 7"), ("'faq_question_only'", "ends_with(own, '?') AND t < 40"),
    ("'faq_answer_only'", "k % 3 = 0 AND NOT contains(own, '?') AND t < 30"), ("'broken_table'", "k % 23 = 4"), ("'missing_provenance'", "coalesce(source, '') = ''"), ("'missing_provenance'", "k % 61 = 8"), ("'nondeterministic_embedding_input'", "k % 40 = 7"),
    ("'duplicate_same_context'", "there IS NOT NULL"), ("'duplicate_same_context'", "other <> id"), ("'duplicate_chunk_id'", "k % 50 = 49"),
)
_CHUNKS = f"""WITH l AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents),
c AS (SELECT *, CASE WHEN k % 19 = 7 THEN 'Page 3 of 9' WHEN k % 19 = 8 THEN 'And when is it due?' ELSE line END AS content, CASE WHEN k % 50 = 49 THEN k - 1 ELSE k END AS id, CASE WHEN k % 3 = 0 THEN 'FAQ' ELSE (k // 10)::VARCHAR END AS part FROM l),
n AS (SELECT *, {_EST.format("content")} AS t, {_STRIP.format("content")} AS own, {_W.format("content")} AS w FROM c),
r AS (SELECT *, lag(id) OVER (PARTITION BY doc_id, lower(own), part ORDER BY k) AS there, lag(id) OVER (PARTITION BY doc_id, lower(own) ORDER BY k) AS other FROM n)
SELECT doc_id AS document_id, category, count(*) AS n, min(k)::INT AS first FROM (SELECT doc_id, k, unnest({_CHUNK_RULES}) AS category FROM r) GROUP BY ALL"""
_QUESTIONS = r"""WITH q AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN 'src' || (item_id % 5) END AS d, CASE WHEN item_id % 4 = 0 THEN 'en' END AS y, CASE WHEN item_id % 5 = 0 THEN 'ocr' END AS e, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{7,}')[1:item_id % 4], lambda x: lower(x))) AS needles, item_id % 2 = 1 AS alone, item_id % 7 < 4 AS paged FROM benchmark),
m AS (SELECT q.*, doc_id, doc_id % 6 <> 0 AS served, CASE WHEN doc_id % 4 <> 1 THEN doc_id % 7 END AS page, list_filter(needles, lambda v: contains(lower(coalesce(text, '')), v)) AS held FROM q JOIN documents ON CASE WHEN y IS NOT NULL THEN coalesce(lang, '') = y WHEN d IS NOT NULL THEN coalesce(source, '') = d ELSE true END AND (e IS NULL OR doc_id % 2 = 0)),
s AS (SELECT query_id, count(DISTINCT v) FILTER (served) AS here, count(DISTINCT v) FILTER (NOT served) AS away FROM (SELECT query_id, served, unnest(held) AS v FROM m) GROUP BY 1),
f AS (SELECT query_id, list(doc_id ORDER BY doc_id) AS ids, arg_min(coalesce(page, -1), doc_id) AS page FROM m WHERE served AND len(needles) > 0 AND len(held) = len(needles) GROUP BY 1),
x AS (SELECT query_id, len(needles) AS n, alone, paged, coalesce(here, 0) = len(needles) AS covered, coalesce(away, 0) = len(needles) AS elsewhere, ids IS NOT NULL AS single, ids, NOT paged OR ids IS NULL OR page >= 0 AS page_ok FROM q LEFT JOIN s USING (query_id) LEFT JOIN f USING (query_id))
SELECT query_id, n AS n_needles, covered, single AS single_chunk, coalesce(array_to_string(ids[1:3], ','), '') AS first_chunks, page_ok, NOT covered AND elsewhere AS lost, covered AND NOT single AND alone AS split, covered AND page_ok AND (single OR NOT alone) AS passed FROM x"""
ORACLE_SQL = {
    "integrity_report": _RECORDS + "SELECT page_id, x.category AS category, x.issue AS issue, x.severity AS severity FROM v",
    "integrity_verdicts": _RECORDS + ", n AS (SELECT page_id, count(*) FILTER (x.severity = 'ERROR') AS errors, count(*) FILTER (x.severity <> 'ERROR') AS warnings FROM v GROUP BY 1) SELECT p.page_id AS document_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS passed FROM pages p LEFT JOIN n USING (page_id)",
    "page_audit": _PAGES, "structure_audit": _STRUCTURE, "chunk_audit": _CHUNKS, "scoped_questions": _QUESTIONS,
}
