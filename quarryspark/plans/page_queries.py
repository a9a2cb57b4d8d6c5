"""Registered queries of pages, reports in one pass and digest trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import digests, pages, reports
from ..sources import scratch
from ..sources.tables import table

FOOTERS = (r"^Page [0-9]+$", r"^confidential\s*$")


def _pages(spark, root):
    """(document_id, page, text): the turns of a conversation as pages, with a header, a mark and upper-case titles; every
    fourth lacks the header."""
    i, n = F.col("conv_id"), F.col("turn")
    head = F.when(n % 4 != 3, F.concat(F.lit("  Conversation "), i.cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    title = F.when(n % 2 == 0, F.concat(F.lit("TITLE OF PART "), (n % 7).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
    text = F.concat(head, title, "text", F.lit("\n\nconfidential\n"), F.lit("Page "), n.cast("string"))
    return table(spark, root, "conversations").where("conv_id is not null and turn is not null").select(i.alias("document_id"), n.alias("page"), text.alias("text"))


def page_repeats(spark, root):
    return pages.repeated_lines(_pages(spark, root))


def _cleaned(spark, root):
    rows = _pages(spark, root)
    return pages.without_repeated(rows, pages.repeated_lines(rows), FOOTERS)


def cleaned_pages(spark, root):
    return _cleaned(spark, root).select("document_id", "page", F.sha2("text", 256).alias("text_sha256"), F.array_join("removed", "|").alias("removed"))


def page_blocks(spark, root):
    return pages.page_blocks(_cleaned(spark, root)).select("document_id", "page", "ord", "node_type", F.sha2("text", 256).alias("text_sha256"))


def audit_summary(spark, root):
    """The pages as audited documents, their lengths as findings."""
    n = F.length("html")
    kept = tx.tidy(tx.without_markup(F.col("html")))
    rows = table(spark, root, "pages").select(
        F.col("page_id").alias("document_id"), urls.website(F.col("url")).alias("website"), F.when(n % 3 == 0, "pdf").otherwise("html").alias("source_type"), F.when(n % 5 == 0, "ocr").otherwise("text").alias("extraction_method"),
        F.when(n % 7 == 0, "FAILED").when(n % 7 == 1, "EXCLUDED").otherwise("VALIDATED").alias("processing_status"), (n % 4).alias("warnings"), F.contains("html", F.lit("nav")).cast("int").alias("boilerplate"),
        F.when(F.length(kept) < n * 0.5, "high_loss").when(F.length(kept) < n * 0.7, "moderate_loss").otherwise("normal").alias("retention_bucket"), (n % 6).alias("ocr_issues"), (n % 2).alias("n_critical"), (n % 3).alias("n_warning"), F.when(n % 11 != 0, n % 5).alias("n_info"),
    )
    return reports.audit_summary(rows).drop("sketch", "n_distinct")


def _questions(spark, root):
    n = F.length("text")
    cause = F.when(n % 13 == 0, "EMBEDDING_REPRESENTATION").when(n % 13 < 3, "CHUNK_FRAGMENTATION").when(n % 13 == 3, "SUMMARY_MISSING").when(n % 13 < 6, "LEXICAL")
    kind = F.when(n % 4 == 0, "SUMMARY").when(n % 4 == 1, "PRODUCT").when(n % 4 == 2, "POLICY").otherwise("COMPANY")
    return table(spark, root, "documents").select(kind.alias("category"), F.when(n % 10 == 0, "CORPUS_GAP").otherwise("ANSWERABLE").alias("answerability"), (n % 5 < 3).alias("passed_at_5"), (n % 5 < 4).alias("passed_at_10"), F.when(n % 5 >= 3, cause).alias("root_cause"), F.when(n % 6 != 5, n % 12 + 1).alias("document_rank"))


def diagnosis_by_category(spark, root):
    return reports.diagnosis(_questions(spark, root))


def diagnosis_verdicts(spark, root):
    return reports.verdicts(reports.diagnosis(_questions(spark, root)))


def _states(spark, root):
    docs = table(spark, root, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content"))
    later = docs.where("doc_id % 97 <> 5").withColumn("content", F.when(F.col("doc_id") % 89 == 7, F.lit("other")).otherwise(F.col("content")))
    return docs, later.union(docs.where("doc_id % 101 = 3").select(F.col("doc_id") + 10_000_000, "lang", "content"))


def digest_tree(spark, root):
    return digests.tree(_states(spark, root)[0], "doc_id", ["lang", "content"])


def digest_changes(spark, root):
    """Two frozen states of the documents: what changed, read from the leaves that differ alone."""
    at, (before, after) = scratch.folder(spark, "frozen"), _states(spark, root)
    for name, rows in (("a", before), ("b", after)):
        digests.freeze(rows, f"{at}/{name}", "doc_id", ["lang", "content"], digits=1)
    names = digests.changed_leaves(*[digests.frozen_tree(spark, f"{at}/{n}") for n in "ab"], digits=1)
    return digests.changes(*[digests.leaves(spark, f"{at}/{n}", names, before) for n in "ab"], "doc_id", ["lang", "content"])


QUERIES = {
    "page_repeats": page_repeats, "cleaned_pages": cleaned_pages, "page_blocks": page_blocks, "audit_summary": audit_summary, "diagnosis_by_category": diagnosis_by_category, "diagnosis_verdicts": diagnosis_verdicts,
    "digest_tree": digest_tree, "digest_changes": digest_changes,
}

_BL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_PAGES = f"""WITH p AS MATERIALIZED (SELECT conv_id AS document_id, turn AS page, CASE WHEN turn % 4 <> 3 THEN '  Conversation ' || conv_id || chr(10) ELSE '' END || CASE WHEN turn % 2 = 0 THEN 'TITLE OF PART ' || turn % 7 || chr(10) ELSE '' END || text || chr(10) || chr(10) || 'confidential' || chr(10) || 'Page ' || turn AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS MATERIALIZED (SELECT document_id, page, trim(unnest(string_split(coalesce(text, ''), chr(10))), {_BL}) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM p),
s AS (SELECT document_id, count(*) AS n_pages FROM p GROUP BY 1), r AS MATERIALIZED (SELECT document_id, line, count(*) AS n, any_value(n_pages) AS n_pages FROM l JOIN s USING (document_id) WHERE line <> '' AND n_pages >= 2 GROUP BY 1, 2 HAVING count(*) >= greatest(2, any_value(n_pages) // 2)),
k AS MATERIALIZED (SELECT l.*, line <> '' AND (r.line IS NOT NULL OR regexp_matches(l.line, '{FOOTERS[0]}') OR regexp_matches(l.line, '{FOOTERS[1]}')) AS gone FROM l LEFT JOIN r USING (document_id, line)),
c AS MATERIALIZED (SELECT document_id, page, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g') AS text, coalesce(string_agg(line, '|' ORDER BY n) FILTER (gone), '') AS removed FROM k GROUP BY 1, 2) """
_HEAD = pages.HEADING.replace("'", "''")
_G = "website, source_type, extraction_method, processing_status"
_MARK = lambda *c: "sha256(" + " || ".join(f"coalesce(length({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')" for x in c) + ")"
_HEX = lambda at: f"sum(('0x' || substr(mark, {at}, 14))::BIGINT::HUGEINT)"
_Q = """WITH q AS (SELECT CASE length(text) % 4 WHEN 0 THEN 'SUMMARY' WHEN 1 THEN 'PRODUCT' WHEN 2 THEN 'POLICY' ELSE 'COMPANY' END AS category, length(text) % 10 <> 0 AS ok, length(text) % 5 < 3 AS p5, length(text) % 5 < 4 AS p10,
  CASE WHEN length(text) % 5 >= 3 THEN CASE WHEN length(text) % 13 = 0 THEN 'EMBEDDING_REPRESENTATION' WHEN length(text) % 13 < 3 THEN 'CHUNK_FRAGMENTATION' WHEN length(text) % 13 = 3 THEN 'SUMMARY_MISSING' WHEN length(text) % 13 < 6 THEN 'LEXICAL' END END AS cause, CASE WHEN length(text) % 6 <> 5 THEN length(text) % 12 + 1 END AS dr FROM documents),
d AS (SELECT category, count(*) AS n, count(*) FILTER (ok) AS n_answerable, count(*) FILTER (NOT ok) AS n_gaps, round_even(100.0::DOUBLE * count(*) FILTER (ok AND p5) / count(*) FILTER (ok), 2) AS pass_at_5_pct, round_even(count(*) FILTER (ok AND p5)::DOUBLE / count(*) FILTER (ok), 4) AS pass_at_5_rate, round_even(count(*) FILTER (ok AND p10)::DOUBLE / count(*) FILTER (ok), 4) AS pass_at_10_rate,
  round_even(count(*) FILTER (ok AND dr <= 5)::DOUBLE / count(*) FILTER (ok), 4) AS document_at_5_rate, round_even(count(*) FILTER (ok AND dr <= 10)::DOUBLE / count(*) FILTER (ok), 4) AS document_at_10_rate, count(*) FILTER (ok AND NOT p10 AND cause IS NOT NULL) AS n_failed, count(*) FILTER (cause = 'EMBEDDING_REPRESENTATION') AS n_embedding, count(*) FILTER (ok AND cause = 'CHUNK_FRAGMENTATION') AS n_fragments, count(*) FILTER (ok AND cause = 'SUMMARY_MISSING') AS n_missing_summaries FROM q GROUP BY ROLLUP (category)) """
ORACLE_SQL = {
    "page_repeats": _PAGES + "SELECT * FROM r",
    "cleaned_pages": _PAGES + "SELECT document_id, page, sha256(text) AS text_sha256, removed FROM c",
    "page_blocks": _PAGES + f""", x AS (SELECT document_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM c),
y AS (SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '{_HEAD}') AND len(string_split_regex(trim(line), '\\s+')) <= {pages.MOST_WORDS} THEN 'heading' ELSE 'paragraph' END AS kind FROM x),
z AS (SELECT *, (kind <> 'blank' AND (kind = 'heading' OR kind <> coalesce(lag(kind) OVER (PARTITION BY document_id, page ORDER BY n), 'blank')))::INT AS st FROM y), o AS (SELECT *, sum(st) OVER (PARTITION BY document_id, page ORDER BY n) - 1 AS ord FROM z),
b AS (SELECT document_id, page, ord::BIGINT AS ord, any_value(kind) AS node_type, string_agg(line, chr(10) ORDER BY n) AS text FROM o WHERE kind <> 'blank' GROUP BY ALL)
SELECT document_id, page, ord, node_type, sha256(text) AS text_sha256 FROM b UNION ALL SELECT document_id, page, 0, 'paragraph', sha256('') FROM c WHERE text = ''""",
    "audit_summary": f"""WITH h AS (SELECT page_id, url, html, length(html) AS n, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<[^>]+>', '', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t\\v\\f]+(\\n|$)', '\\1', 'g'), '^[ \\t\\n]+|[ \\t\\n]+$', '', 'g')) AS k FROM pages),
r AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '') AS website, CASE WHEN n % 3 = 0 THEN 'pdf' ELSE 'html' END AS source_type, CASE WHEN n % 5 = 0 THEN 'ocr' ELSE 'text' END AS extraction_method, CASE n % 7 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'EXCLUDED' ELSE 'VALIDATED' END AS processing_status,
  n % 4 AS warnings, contains(html, 'nav') AS boilerplate, CASE WHEN k < n * 0.5 THEN 'high_loss' WHEN k < n * 0.7 THEN 'moderate_loss' ELSE 'normal' END AS loss, n % 6 AS ocr_issues, n % 2 AS nc, n % 3 AS nw, CASE WHEN n % 11 <> 0 THEN n % 5 ELSE 0 END AS ni FROM h)
SELECT CASE WHEN grouping(website, source_type, extraction_method, processing_status) = 15 THEN 'all' ELSE concat_ws('+', CASE WHEN grouping(website) = 0 THEN 'website' END, CASE WHEN grouping(source_type) = 0 THEN 'source_type' END, CASE WHEN grouping(extraction_method) = 0 THEN 'extraction_method' END, CASE WHEN grouping(processing_status) = 0 THEN 'processing_status' END) END AS grouping, {_G}, count(*) AS n,
  count(*) FILTER (warnings > 0) AS n_with_warnings, count(*) FILTER (boilerplate) AS n_boilerplate, count(*) FILTER (loss = 'high_loss') AS n_high_loss, count(*) FILTER (loss = 'moderate_loss') AS n_moderate_loss, count(*) FILTER (ocr_issues > 0) AS n_ocr_issues, sum(nc)::BIGINT AS n_critical, sum(nw)::BIGINT AS n_warning, sum(ni)::BIGINT AS n_info, count(*) FILTER (nc + nw + ni > 0) AS n_to_review
FROM r GROUP BY GROUPING SETS ((website), (source_type), (extraction_method), (processing_status), (website, source_type), ())""",
    "diagnosis_by_category": _Q + "SELECT * FROM d",
    "diagnosis_verdicts": _Q + f"""SELECT CASE WHEN n_fragments < {reports.FRAGMENTS} AND n_missing_summaries < {reports.MISSING_SUMMARIES} THEN 'GOOD' ELSE '{reports.WORSE}' END AS chunking_quality, CASE WHEN pass_at_5_rate >= {reports.LEAST_PASS_AT_5} THEN 'GOOD' ELSE '{reports.WORSE}' END AS retrieval_quality,
  CASE WHEN (SELECT pass_at_5_pct FROM d WHERE category = 'SUMMARY') >= {reports.LEAST_SUMMARY_PASS} THEN 'GOOD' ELSE '{reports.WORSE}' END AS summary_representation, CASE WHEN n_gaps <= {reports.MOST_GAPS} THEN 'GOOD' ELSE '{reports.WORSE}' END AS corpus_quality, CASE WHEN n_failed > 0 AND n_embedding::DOUBLE / n_failed >= {reports.MOST_EMBEDDING} THEN 'INVESTIGATE' ELSE 'DO_NOT_CHANGE' END AS embedding_model FROM d WHERE category IS NULL""",
    "digest_tree": f"""WITH m AS (SELECT substr(sha256(doc_id::VARCHAR), 1, 2) AS node, {_MARK("doc_id", "lang", "sha256(text)")} AS mark FROM documents), l2 AS (SELECT node, count(*) AS n, sha256(count(*) || '|' || {_HEX(1)} || '|' || {_HEX(15)}) AS digest FROM m GROUP BY 1),
l1 AS (SELECT substr(node, 1, 1) AS node, sum(n)::BIGINT AS n, sha256(string_agg(l2.node || '=' || digest, ',' ORDER BY l2.node)) AS digest FROM l2 GROUP BY substr(node, 1, 1)), l0 AS (SELECT '' AS node, sum(n)::BIGINT AS n, sha256(string_agg(node || '=' || digest, ',' ORDER BY node)) AS digest FROM l1)
SELECT 2 AS level, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0""",
    "digest_changes": "SELECT doc_id, 'removed' AS change FROM documents WHERE doc_id % 97 = 5 UNION ALL SELECT doc_id, 'changed' FROM documents WHERE doc_id % 97 <> 5 AND doc_id % 89 = 7 UNION ALL SELECT doc_id + 10000000, 'added' FROM documents WHERE doc_id % 101 = 3",
}
