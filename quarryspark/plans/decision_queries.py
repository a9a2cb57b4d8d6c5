"""Registered decisions: pages are crawled HTML, documents texts read by OCR, their lines chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import corpus, decisions
from ..sources.tables import table
from .corpus_queries import _CLEAN, _EST, _page_texts

#: The websites of the corpus, and what is in its scope: the caller's, here for the test tables.
SITES = tuple(f"ththre.example.{end}" for end in ("com", "net", "org")) + tuple(f"ththth.example.{end}" for end in ("com", "net", "org")) + tuple(f"thther.example.{end}" for end in ("com", "net", "org"))
SCOPE = r"(?i)(^|[^\p{L}\p{N}_])(warranty|return|refund|policy|license|the|der|la|de)($|[^\p{L}\p{N}_])"


def _pages(spark, root):
    html = table(spark, root, "pages").select("page_id", F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)).alias("headings"))
    return _page_texts(spark, root).join(html, "page_id").withColumn("policy", decisions.website_policy(urls.website(F.col("url")), SITES))


def _reason():
    return decisions.exclusion(F.col("policy"), F.col("url"), F.col("title"), F.col("text"))


def page_policy(spark, root):
    return _pages(spark, root).select("page_id", "policy", _reason().alias("reason"))


def document_types(spark, root):
    kind = F.when(F.col("url").rlike(r"(?i)\.pdf($|[?#])"), "pdf").otherwise("html")
    return _pages(spark, root).select("page_id", decisions.document_type(F.col("url"), F.col("title"), kind, decisions.faq_structure(F.col("title"), F.col("headings"))).alias("type"))


def validated_documents(spark, root):
    """Pages as cleaned, against their markup-free text before it was tidied."""
    before = table(spark, root, "pages").select("page_id", tx.without_markup(F.col("html")).alias("before"))
    rows = _pages(spark, root).join(before, "page_id")
    state = decisions.validated(F.col("text"), F.col("before"), F.col("title"), F.col("url"), F.lit("html"), _reason().isNotNull())
    found = rows.select("page_id", "policy", state.alias("v"))
    return found.select("page_id", "v.status", F.array_join("v.errors", ",").alias("errors"), F.array_join("v.warnings", ",").alias("warnings"), decisions.downstream_eligible(F.col("policy"), F.col("v.status")).alias("goes_on"))


def exclusion_integrity(spark, root):
    """Pages whose URL holds a query are marked as excluded by hand, every other one without a reason."""
    known = (decisions.NON_TARGET, decisions.NOT_REQUIRED, decisions.CART, decisions.THIRD_PARTY, decisions.NOT_FOUND)
    marked = F.contains("url", F.lit("?"))
    reason = F.when(marked & (F.col("page_id") % 2 == 0), "by hand").otherwise(_reason())
    status = F.when(_reason().isNotNull(), "EXCLUDED").otherwise("ACTIVE")
    issues = decisions.exclusion_issues(F.col("policy"), status, marked, reason, known)
    return _pages(spark, root).select("page_id", F.explode(issues).alias("issue"))


def low_value_documents(spark, root):
    rows = table(spark, root, "documents").select("doc_id", decisions.low_value(F.col("text")).alias("v")).where("v is not null")
    return rows.select("doc_id", "v.tokens", "v.classification", decisions.after_low_value(F.lit("ELIGIBLE"), F.col("v.classification")).alias("status"))


def ocr_lines(spark, root):
    shares = decisions.letter_shares(F.col("text"))
    n = lambda least: F.size(F.filter("s", lambda x: x < least)).cast("long")
    return table(spark, root, "documents").select("doc_id", shares.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_lines"), n(0.45).alias("noisy"), n(0.35).alias("very_noisy"))


def ocr_grades(spark, root):
    t = F.col("text")
    return table(spark, root, "documents").select("doc_id", decisions.ocr_grade(t).alias("grade"), decisions.ocr_concern(t).alias("concern"), decisions.ocr_corrupted(t).alias("corrupted"))


AMBIGUOUS = ("https://src3/x/", "https://src11/x")
KINDS = ("other", "product", "webpage", "other", "notice", "blog")


def review_decisions(spark, root):
    """Documents under review: their kinds by number, every fifth by OCR with up to seven marks of bad readings, every
    eleventh cut to a short text."""
    i = F.col("doc_id")
    text = F.when(i % 11 == 4, F.left("text", F.lit(90))).otherwise(F.col("text"))
    text = F.when(i % 5 == 0, F.concat(text, F.repeat(F.lit(" ~^~^~ ok"), (i % 8).cast("int")))).otherwise(text)
    rows = table(spark, root, "documents").select("doc_id", F.concat(F.lit("https://"), "source", F.when(i % 4 == 0, "/x/").otherwise("/x")).alias("url"), F.when(i % 13 != 7, text).alias("text"), F.element_at(F.array(*map(F.lit, KINDS)), (i % 6 + 1).cast("int")).alias("kind"))
    made = decisions.review_decision(F.col("url"), F.col("text"), F.col("kind"), i % 5 == 0, SCOPE, AMBIGUOUS, F.when(i % 2 == 0, "ocr_quality"))
    return rows.select("doc_id", made.alias("d")).select("doc_id", "d.*", decisions.after_review(F.lit("REVIEW"), F.col("d.decision")).alias("status"))


def _chunks(spark, root):
    return corpus.line_chunks(table(spark, root, "documents")).withColumn("chunk_id", F.concat_ws(":", "document_id", "chunk_index"))


def _issues():
    return decisions.chunk_issues(F.col("content"), F.col("token_count"), document_id=F.col("document_id"), source_file_hash=F.col("website"))


def chunk_issues(spark, root):
    rows = _chunks(spark, root).select("document_id", F.explode(_issues()).alias("issue"))
    return rows.groupBy("document_id", "issue").agg(F.count("*").alias("n"))


def chunk_quality_gate(spark, root):
    return decisions.quality_gate(_chunks(spark, root), _issues())


def chunk_set_issues(spark, root):
    """Lines of the same content within the set; ids are unique."""
    rows = _chunks(spark, root).where("trim(content) <> ''").select("chunk_id", F.sha2("content", 256).alias("input_hash"))
    return decisions.set_issues(rows, "chunk_id", "input_hash")


def embed_rejections(spark, root):
    """Lines by what the gate of embeddings says of a status: that of their length."""
    status = F.when(F.col("token_count") == 0, "DO_NOT_EMBED").when(F.col("token_count") < 8, "REVIEW").when(F.col("token_count") > 512, "OVERSIZED").otherwise("EMBED_READY")
    rows = _chunks(spark, root).select(decisions.embeddable(status).alias("rejected"))
    return rows.groupBy(F.coalesce("rejected", F.lit("embedded")).alias("outcome")).agg(F.count("*").alias("n"))


def extraction_quality(spark, root):
    """Each source as one extraction, its documents being the pages, its lines the blocks."""
    docs = table(spark, root, "documents").select(F.coalesce("source", F.lit("")).alias("source"), tx.meaningful_characters(F.col("text")).alias("c"), tx.word_count(F.col("text")).alias("w"), F.size(F.split(tx.filled(F.col("text")), "\n")).alias("b"))
    sums = docs.groupBy("source").agg(F.count("*").alias("pages"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.sum("b").alias("b"))
    return sums.select("source", "pages", decisions.extraction_quality(F.col("pages"), F.col("c"), F.col("w"), F.col("b"), F.lit(0.0)).alias("q")).select("source", "pages", "q.score", "q.poor")


def extraction_issues(spark, root):
    docs = table(spark, root, "documents")
    n = F.size(F.filter(F.split(tx.filled(F.col("text")), "\n"), lambda s: s != ""))
    return docs.select("doc_id", F.explode(decisions.extraction_issues(F.col("text"), n, document_id=F.col("doc_id"), file_hash=F.col("source"))).alias("issue"))


def chunk_problems(spark, root):
    rows = _chunks(spark, root).withColumn("method", F.when(F.col("chunk_index") % 5 == 0, "hard").otherwise("line"))
    return decisions.chunk_problems(rows, 100)


QUERIES = {
    "extraction_issues": extraction_issues, "chunk_problems": chunk_problems,
    "page_policy": page_policy, "document_types": document_types, "validated_documents": validated_documents, "exclusion_integrity": exclusion_integrity, "low_value_documents": low_value_documents,
    "ocr_lines": ocr_lines, "ocr_grades": ocr_grades, "review_decisions": review_decisions, "chunk_issues": chunk_issues, "chunk_quality_gate": chunk_quality_gate, "chunk_set_issues": chunk_set_issues,
    "embed_rejections": embed_rejections, "extraction_quality": extraction_quality,
}

#: The signs of bad readings without a back reference: five equal characters, one character at a time.
_EQUAL = "|".join(f"\\x{{{ord(c):x}}}{{5,}}" for c in map(chr, [9, *range(32, 127), *range(161, 384), 0x2013, 0x2014, 0x20B9]))
_SIGNS = _EQUAL + "|" + decisions.OCR_GARBAGE.split("|", 1)[1].replace("'", "''")

_P = rf"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, html, {_CLEAN} AS text, regexp_extract_all(html, '<h[1-6][^>]*>(.*?)</h[1-6]>', 1, 's') AS headings,
  CASE WHEN regexp_matches(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1)), '^(www\.)?th(thre|thth|ther)\.example\.(com|net|org)$') THEN 'TARGET' ELSE 'NON_TARGET' END AS policy FROM pages),
x AS (SELECT *, CASE WHEN policy <> 'TARGET' THEN 'non-target website' WHEN contains(lower(url), '/cart') OR contains(lower(url), '/checkout') THEN 'cart/checkout page' WHEN contains(lower(url), '/apps/') THEN 'third-party app embed'
  WHEN regexp_matches(title, '(?i)404|not found') OR contains(lower(left(text, 500)), 'page not found') THEN '404 page' END AS reason FROM p) """
_RAW = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gsi'), '<style[^>]*>.*?</style>', '', 'gsi'), '<[^>]+>', '', 'g')"""
_N = r"length(regexp_replace(coalesce({}, ''), '[^\p{{L}}\p{{N}}_]', '', 'g'))"
_WORDS = r"len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda w: w <> ''))"
_ROWS = "WITH l AS (SELECT doc_id AS document_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS content FROM documents), c AS (SELECT *, " + _EST.format("content") + r" AS token_count, regexp_replace(content, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS own FROM l), i AS (SELECT *, list_filter([CASE WHEN own = '' THEN 'empty_content' END, CASE WHEN token_count <= 0 THEN 'invalid_token_count' END, CASE WHEN token_count > 512 THEN 'token_limit_exceeded' END, CASE WHEN document_id IS NULL THEN 'missing_document_id' END, CASE WHEN coalesce(source, '') = '' THEN 'missing_source_file_hash' END, CASE WHEN contains(lower(content), 'embedding_version:') THEN 'forbidden_metadata_leakage' END, CASE WHEN contains(lower(content), 'chunk_id:') THEN 'forbidden_metadata_leakage' END, CASE WHEN contains(lower(content), 'document_version:') THEN 'forbidden_metadata_leakage' END, CASE WHEN own = '' OR (length(own) < 4 AND NOT regexp_matches(own, '[a-zA-Z0-9]')) OR (length(own) > 20 AND length(regexp_replace(own, '[^\\p{L}]', '', 'g'))::DOUBLE / length(own) < 0.15) THEN 'ocr_garbage' END, CASE WHEN length(own) < 120 AND regexp_matches(lower(own), 'page |you may also like|add to cart|write a review|sort by') THEN 'ui_debris' END], lambda x: x IS NOT NULL) AS issues FROM c) ".replace("\\\\p", "\\p")
ORACLE_SQL = {
    "extraction_issues": r"WITH t AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS own, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, unnest(list_filter([CASE WHEN n = 0 THEN 'empty_extraction' END, CASE WHEN own = '' THEN 'empty_text' END, CASE WHEN own <> '' AND length(own) < 40 THEN 'below_min_text_threshold' END, CASE WHEN length(own) > 20 AND length(regexp_replace(own, '[^\p{L}]', '', 'g'))::DOUBLE / length(own) < 0.15 THEN 'excessive_garbage' END, CASE WHEN doc_id IS NULL THEN 'missing_document_id' END, CASE WHEN coalesce(source, '') = '' THEN 'missing_file_hash' END, CASE WHEN n > 0 AND own = '' THEN 'structure_missing' END], lambda x: x IS NOT NULL)) AS issue FROM t",
    "chunk_problems": _ROWS.replace("AS content FROM documents)", "AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)") + "SELECT 'empty_content' AS category, 'P1' AS severity, count(*) FILTER (own = '') AS n FROM c UNION ALL SELECT 'invalid_token_count', 'P1', count(*) FILTER (token_count <= 0) FROM c UNION ALL SELECT 'token_limit_exceeded', 'P1', count(*) FILTER (token_count > 100 AND pos % 5 <> 0) FROM c UNION ALL SELECT 'duplicate_chunk_id', 'P0', (SELECT count(*) - count(DISTINCT (document_id, pos)) FROM c) UNION ALL SELECT 'duplicate_content', 'P2', (SELECT count(*) - count(DISTINCT (document_id, content)) FROM c)",
    "page_policy": _P + "SELECT page_id, policy, reason FROM x",
    "document_types": _P + r"""SELECT page_id, CASE WHEN contains(lower(url), '/products/') THEN 'product' WHEN (contains(lower(url), '/pages/') AND regexp_matches(lower(url), 'terms|privacy|return|warranty|policy|shipping|refund')) OR regexp_matches(lower(title), 'terms & conditions|privacy policy|return|warranty') THEN 'policy'
      WHEN regexp_matches(lower(title), 'faq|frequently asked') OR len(list_filter(headings, lambda h: regexp_matches(lower(h), 'faq|frequently asked'))) > 0 OR contains(lower(url), 'faq') THEN 'faq' WHEN contains(lower(url), '/blog/') OR contains(lower(title), 'blog') THEN 'blog'
      WHEN contains(lower(url), '/investor/') THEN CASE WHEN regexp_matches(lower(url), 'notice|agenda|outcome|pre-intimation|/gm/|/bt/') THEN 'notice' ELSE 'investor' END WHEN regexp_matches(url, '(?i)\.pdf($|[?#])') THEN 'other' ELSE 'webpage' END AS type FROM x""",
    "validated_documents": _P + f""", m AS (SELECT *, {_N.format("text")} AS n, {_N.format(_RAW)} AS b FROM x), s AS (SELECT *, CASE WHEN b > 0 THEN n::DOUBLE / b END AS share FROM m),
      e AS (SELECT *, list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN coalesce(url, '') = '' THEN 'missing source_url' END, CASE WHEN n < 80 THEN 'too short' END, CASE WHEN share < 0.5 THEN 'excessive loss' END], lambda v: v IS NOT NULL) AS errors,
        list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing title' END, CASE WHEN share >= 0.5 AND share < 0.7 THEN 'high reduction' END, CASE WHEN contains(text, 'Your cart is empty') THEN 'remaining: Your cart is empty' END, CASE WHEN contains(text, '### Quick Links') THEN 'remaining: ### Quick Links' END,
          CASE WHEN contains(text, 'Become Our Partner') THEN 'remaining: Become Our Partner' END, CASE WHEN contains(text, '[Judge.me]') THEN 'remaining: [Judge.me]' END], lambda v: v IS NOT NULL) AS warnings FROM s),
      f AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'EXCLUDED' WHEN len(errors) > 0 THEN 'FAILED' WHEN len(warnings) > 0 THEN 'VALIDATED' ELSE 'ACTIVE' END AS status FROM e)
      SELECT page_id, status, CASE WHEN status <> 'EXCLUDED' THEN coalesce(array_to_string(errors, ','), '') END AS errors, CASE WHEN status <> 'EXCLUDED' THEN coalesce(array_to_string(warnings, ','), '') END AS warnings, policy = 'TARGET' AND status IN ('ACTIVE', 'VALIDATED') AS goes_on FROM f""",
    "exclusion_integrity": _P + """, m AS (SELECT page_id, policy, contains(url, '?') AS marked, CASE WHEN contains(url, '?') AND page_id % 2 = 0 THEN 'by hand' ELSE reason END AS r, CASE WHEN reason IS NULL THEN 'ACTIVE' ELSE 'EXCLUDED' END AS status FROM x)
      SELECT page_id, unnest(list_filter([CASE WHEN marked AND status <> 'EXCLUDED' THEN 'metadata.excluded set but status is not EXCLUDED' END, CASE WHEN (marked OR status = 'EXCLUDED') AND coalesce(r, '') = '' THEN 'missing exclusion_reason' END, CASE WHEN r = 'by hand' THEN 'unknown exclusion_reason' END,
        CASE WHEN status = 'ACTIVE' AND policy <> 'TARGET' THEN 'NON_TARGET document has production status' END, CASE WHEN status = 'ACTIVE' AND marked THEN 'excluded metadata on ACTIVE/VALIDATED document' END], lambda v: v IS NOT NULL)) AS issue FROM m""",
    "low_value_documents": f"WITH n AS (SELECT doc_id, {_WORDS} AS tokens, regexp_matches(coalesce(text, ''), '(?i)click the map to enable')::INT + regexp_matches(coalesce(text, ''), '(?i)^send message$')::INT + regexp_matches(coalesce(text, ''), '(?i)^message us$')::INT + regexp_matches(coalesce(text, ''), '(?i)^drop us message')::INT AS hits FROM documents) SELECT doc_id, tokens, CASE WHEN hits >= 2 THEN 'NOT_USEFUL' ELSE 'REVIEW' END AS classification, CASE WHEN hits >= 2 THEN 'EXCLUDED' ELSE 'REVIEW' END AS status FROM n WHERE tokens < 100",
    "ocr_lines": r"WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\f\v]'), lambda s: regexp_replace(s, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), lambda s: s <> '') AS s FROM documents), r AS (SELECT doc_id, list_transform(s, lambda x: length(regexp_replace(x, '[^\p{L}]', '', 'g'))::DOUBLE / length(x)) AS s FROM l) SELECT doc_id, len(s) AS n_lines, len(list_filter(s, lambda x: x < 0.45)) AS noisy, len(list_filter(s, lambda x: x < 0.35)) AS very_noisy FROM r",
    "review_decisions": rf"""WITH b AS (SELECT doc_id, 'https://' || source || '/x' AS url, [{", ".join(f"'{k}'" for k in KINDS)}][doc_id % 6 + 1] AS kind, doc_id % 5 = 0 AS ocr, coalesce(CASE WHEN doc_id % 13 <> 7 THEN CASE WHEN doc_id % 11 = 4 THEN left(text, 90) ELSE text END || CASE WHEN doc_id % 5 = 0 THEN repeat(' ~^~^~ ok', doc_id % 8) ELSE '' END END, '') AS text FROM documents),
m AS (SELECT *, length(regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g')) AS n, len(regexp_extract_all(text, '{_SIGNS}')) AS g, regexp_matches(text, '{SCOPE}') AS said, len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS words FROM b),
o AS (SELECT *, CASE WHEN NOT ocr THEN 'GOOD' WHEN trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) = '' OR g >= 6 THEN 'UNUSABLE' WHEN g >= 4 THEN 'SUBSTANTIAL' WHEN g >= 1 THEN 'MINOR' WHEN length(text) > 400 AND words < 25 THEN 'UNUSABLE' ELSE 'GOOD' END AS grade, said OR kind IN ('product', 'notice') AS s FROM m),
r AS (SELECT *, CASE WHEN url IN ({", ".join(f"'{u.rstrip('/')}'" for u in AMBIGUOUS)}) THEN 1 WHEN grade = 'UNUSABLE' THEN 2 WHEN grade = 'SUBSTANTIAL' THEN 3 WHEN kind = 'other' AND NOT s AND n < 500 THEN 4 WHEN n >= 200 AND s THEN 5 ELSE 6 END AS k FROM o)
SELECT doc_id, CASE WHEN k = 5 THEN 'APPROVE' ELSE 'KEEP_REVIEW' END AS decision, CASE WHEN k <= 3 THEN 'high' WHEN k = 4 THEN 'medium' WHEN k = 6 THEN 'low' WHEN grade = 'GOOD' THEN 'high' ELSE 'medium' END AS confidence,
  ['Document type and production RAG relevance remain uncertain', 'OCR grade UNUSABLE — content not reliably readable for retrieval', 'OCR grade SUBSTANTIAL — errors may materially affect retrieval accuracy', 'Ambiguous relevance with insufficient in-scope signals', 'Content is meaningful, in-scope, and sufficiently readable for retrieval', 'Insufficient evidence to approve or reject automatically'][k] AS reason,
  CASE k WHEN 1 THEN 'type=' || kind || ', meaningful_chars=' || n || ', url is ambiguous' WHEN 2 THEN 'ocr_grade=' || grade || ', garbage_signals=' || g || ', meaningful_chars=' || n WHEN 3 THEN 'ocr_grade=' || grade || ', garbage_signals=' || g WHEN 4 THEN 'type=' || kind || ', meaningful_chars=' || n || ', in_scope_keywords=' || said WHEN 5 THEN 'type=' || kind || ', ocr_grade=' || grade || ', meaningful_chars=' || n || ', review_reason=' || CASE WHEN doc_id % 2 = 0 THEN 'ocr_quality' ELSE 'None' END ELSE 'type=' || kind || ', meaningful_chars=' || n || ', in_scope=' || s END AS evidence,
  CASE WHEN k = 5 THEN 'ELIGIBLE' ELSE 'REVIEW' END AS status FROM r""",
    "chunk_issues": _ROWS + "SELECT document_id, issue, count(*) AS n FROM (SELECT document_id, unnest(issues) AS issue FROM i) GROUP BY ALL",
    "chunk_quality_gate": _ROWS + "SELECT count(*) AS generated, count(*) FILTER (len(issues) = 0) AS n_passed, count(*) FILTER (len(issues) > 0) AS n_failed, count(*) FILTER (token_count < 25) AS n_small, max(token_count) AS most, round_even(avg(token_count), 4) AS mean, CASE WHEN count(*) FILTER (len(issues) > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS determinism FROM i",
    "chunk_set_issues": _ROWS + "SELECT 'duplicate_chunks' AS issue, sha256(content) AS key, count(*) AS n FROM c WHERE trim(content) <> '' GROUP BY content HAVING count(*) > 1",
    "embed_rejections": _ROWS + "SELECT CASE WHEN token_count = 0 THEN 'DO_NOT_EMBED chunk rejected' WHEN token_count < 8 THEN 'REVIEW chunk rejected' WHEN token_count > 512 THEN 'invalid eligibility status' ELSE 'embedded' END AS outcome, count(*) AS n FROM c GROUP BY 1",
    "extraction_quality": f"WITH d AS (SELECT coalesce(source, '') AS source, count(*) AS pages, sum({_N.format('text')})::BIGINT AS c, sum({_WORDS})::BIGINT AS w, sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS b FROM documents GROUP BY 1) SELECT source, pages, round_even(50.0::DOUBLE * least(c::DOUBLE / pages / 500.0::DOUBLE, 1.0) + 30.0::DOUBLE * least(w::DOUBLE / pages / 80.0::DOUBLE, 1.0) + 10.0::DOUBLE * least(b::DOUBLE / (3 * pages), 1.0), 4) AS score, c = 0 OR c::DOUBLE / pages < 150 AS poor FROM d",
}
