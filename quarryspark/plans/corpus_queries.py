"""Registered corpus queries: documents are canonical texts, pages raw crawls, events a trace."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import chunking, corpus
from ..sources.tables import table


def _docs(spark, root):
    return table(spark, root, "documents")


def _pages(spark, root):
    return table(spark, root, "pages")


def _hashed(spark, root):
    return _docs(spark, root).select("doc_id", "source", tx.content_hash(F.col("text")).alias("content_hash"))


def dup_content_hash(spark, root):
    return corpus.duplicate_groups(_hashed(spark, root), ["content_hash"], "doc_id")


def dup_cross_source(spark, root):
    return corpus.duplicate_groups(_hashed(spark, root), ["content_hash"], "doc_id", "source")


def _urls(spark, root):
    return _pages(spark, root).select("page_id", "url", urls.website(F.col("url")).alias("website"), urls.normalised(F.col("url")).alias("normalised"))


def dup_url_alias(spark, root):
    return corpus.duplicate_groups(_urls(spark, root), ["normalised"], "page_id")


def dup_query_param(spark, root):
    return corpus.duplicate_groups(_urls(spark, root), ["normalised"], "page_id", "url")


def dup_first_kept(spark, root):
    rows = _hashed(spark, root).select("doc_id", "content_hash")
    return corpus.kept_first(rows, ["content_hash"], ["doc_id"], "doc_id")


def dup_suppressed_report(spark, root):
    return dup_first_kept(spark, root).where("not kept").groupBy("duplicate_of").agg(F.count("*").alias("n_suppressed"))


def website_counts(spark, root):
    return _urls(spark, root).groupBy("website").agg(F.count("*").alias("n_pages"), F.count_distinct("normalised").alias("n_documents"))


def document_identity(spark, root):
    return _urls(spark, root).select("page_id", "website", urls.document_id(F.col("website"), F.col("url")).alias("document_id"))


def html_clean(spark, root):
    clean = tx.tidy(tx.without_markup(F.col("html")))
    rows = _pages(spark, root).select("page_id", "html", clean.alias("text")).withColumn("retention", corpus.retention(F.col("html"), F.col("text")))
    return rows.select("page_id", F.length("html").alias("n_html"), F.length("text").alias("n_text"), F.sha2("text", 256).alias("text_sha256"), "retention", corpus.retention_bucket(F.col("retention")).alias("bucket"))


def extract_links(spark, root):
    rows = _pages(spark, root).select("page_id", F.posexplode(corpus.links(F.col("page_id"), F.col("html"))).alias("at", "link"))
    first = rows.groupBy("page_id", F.col("link.url").alias("url")).agg(F.min_by("link.label", "at").alias("label"))
    return first.where(~F.lower(F.trim("label")).isin(*corpus.NAVIGATION))


def repeated_lines(spark, root):
    return corpus.repeated_lines(_docs(spark, root))


def token_counts(spark, root):
    t = F.col("text")
    return _docs(spark, root).select("doc_id", tx.token_estimate(t).alias("token_estimate"), tx.word_count(t).alias("words"), tx.word_count(t, 1).alias("words_at_least_one"), tx.meaningful_characters(t).alias("meaningful"))


def sentence_split(spark, root):
    return _docs(spark, root).select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("sentence", "text"))


def greedy_chunks(spark, root):
    return chunking.chunked(_docs(spark, root)).select("document_id", "chunk_index", "token_count", "content")


def chunk_ids(spark, root):
    return chunking.chunked(_docs(spark, root)).select("document_id", "chunk_index", "chunk_id")


def noise_classify(spark, root):
    lines = corpus.line_chunks(_docs(spark, root))
    found = lines.withColumn("noise", corpus.noise(F.col("content"), F.col("token_count")))
    return found.groupBy(F.coalesce("noise.reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.max("noise.confidence").alias("confidence"))


def chunk_gate(spark, root):
    gated = corpus.chunk_gate(corpus.line_chunks(_docs(spark, root)))
    return gated.groupBy("document_id", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"), F.min("chunk_index").alias("first"))


def _page_texts(spark, root):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return _pages(spark, root).select("page_id", "url", title.alias("title"), tx.tidy(tx.without_markup(F.col("html"))).alias("text"))


def eligibility_gate(spark, root):
    found = _page_texts(spark, root).withColumn("gate", corpus.page_eligibility(F.col("url"), F.col("title"), F.col("text")))
    return found.select("page_id", "gate.status", "gate.reason")


def document_issues(spark, root):
    rows = _docs(spark, root).select("doc_id", F.explode(corpus.document_issues(F.col("text"))).alias("issue"))
    return rows


def gate_vs_labels(spark, root):
    n = tx.meaningful_characters(F.col("text"))
    docs = _docs(spark, root).select("doc_id", F.when(n < 250, "REVIEW").otherwise("ELIGIBLE").alias("status"))
    return docs.join(table(spark, root, "labels"), "doc_id").groupBy("status", "quality").agg(F.count("*").alias("n"))


def redact_pii(spark, root):
    """What each whole text becomes, by its hash, and how many replacements of each kind it has."""
    rows = _docs(spark, root).select("doc_id", tx.redacted(F.col("text")).alias("t"))
    n = lambda mark: F.regexp_count("t", F.lit(rf"\[{mark}\]")).cast("long").alias(f"n_{mark}")
    return rows.select("doc_id", n("phone"), n("email"), n("api_key"), F.sha2("t", 256).alias("redacted_sha256"))


def manifest_counts(spark, root):
    return corpus.manifest(_docs(spark, root), "lang", "source")


def corpus_diff(spark, root):
    """The documents against what tidying makes of them, Spanish ones left out."""
    docs = _docs(spark, root)
    child = docs.where("lang <> 'es'").select("doc_id", tx.content_hash(F.trim(F.regexp_replace("text", r"[ \t\n]+", " "))).alias("h"))
    return corpus.difference(docs.select("doc_id", tx.content_hash(F.col("text")).alias("h")), child, "doc_id", "h")


def largest_remainder(spark, root):
    weights = table(spark, root, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("w"))
    return corpus.apportioned(weights, 1000, "o_orderpriority", "w")


QUERIES = {
    "dup_content_hash": dup_content_hash, "dup_cross_source": dup_cross_source, "dup_url_alias": dup_url_alias, "dup_query_param": dup_query_param, "dup_first_kept": dup_first_kept,
    "dup_suppressed_report": dup_suppressed_report, "url_normalize": _urls, "website_counts": website_counts, "document_identity_uuid5": document_identity, "html_clean_retention": html_clean,
    "extract_links": extract_links, "repeated_lines": repeated_lines, "token_counts": token_counts, "sentence_split": sentence_split, "greedy_chunks": greedy_chunks, "chunk_ids": chunk_ids,
    "noise_classify": noise_classify, "chunk_gate": chunk_gate, "eligibility_gate": eligibility_gate, "document_issues": document_issues, "gate_vs_labels": gate_vs_labels, "redact_pii": redact_pii,
    "manifest_counts": manifest_counts, "corpus_diff_fingerprint": corpus_diff, "largest_remainder_alloc": largest_remainder,
}

_H = "WITH h AS (SELECT doc_id, source, 'sha256:' || sha256(coalesce(text, '')) AS content_hash FROM documents) "
_TRACK = ", ".join(f"'{x}'" for x in urls.TRACKING)
_INDEX = ", ".join(f"'{x}'" for x in urls.INDEX)
_U = r"""WITH a AS (SELECT page_id, url, regexp_extract(trim(url), '^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', ['s', 'h', 'p', 'q']) AS r FROM pages),
b AS (SELECT page_id, url, lower(coalesce(nullif(r.s, ''), 'https')) AS scheme, regexp_replace(lower(r.h), '^www\.', '') AS host, url_decode(replace(r.p, '+', '%2B')) AS path,
  list_sort(list_filter(string_split(r.q, '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND lower(split_part(x, '=', 1)) NOT IN (TRACK))) AS pairs FROM a),
c AS (SELECT *, string_split(regexp_replace(path, '/+$', ''), '/') AS seg FROM b),
u AS (SELECT page_id, url, host AS website, CASE WHEN trim(url) = '' THEN '' ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN lower(seg[-1]) IN (INDEXES) THEN regexp_replace('/' || array_to_string(list_filter(seg[:-2], lambda x: x <> ''), '/'), '(.)/+$', '\1')
  ELSE coalesce(nullif(regexp_replace(path, '(.)/+$', '\1'), ''), '/') END || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END END AS normalised FROM c) """.replace("TRACK", _TRACK).replace("INDEXES", _INDEX)
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gsi'), '<style[^>]*>.*?</style>', '', 'gsi'), '<[^>]+>', '', 'g'), '\r\n?', '
', 'g'), '\n{3,}', '

', 'g'), '[ \t\v\f]+(\n|$)', '\1', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"""
_W = r"len(list_filter(string_split_regex({}, '[ \t\n\r\f\v]+'), lambda w: w <> ''))"
_EST = r"CASE WHEN trim(regexp_replace(coalesce({0}, ''), '[ \t\n\r\f\v]+', ' ', 'g')) = '' THEN 0 ELSE greatest(1, floor(length({0}) / 4.0::DOUBLE + 0.999::DOUBLE))::BIGINT END"
_LINES = "WITH l AS (SELECT doc_id AS document_id, source AS website, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS chunk_index FROM documents), n0 AS (SELECT *, " + _EST.format("content") + " AS token_count, trim(content) AS body FROM l), "
_SMALL = r"(regexp_matches(body, '^[0-9]+(\.[0-9]+)+\s+') OR (contains(body, ':') AND " + _W.format("body") + r" >= 2) OR regexp_matches(body, '(?i)(battery size|within [A-Za-z0-9_]+ days|rma required|return/replacement|eligibility|ms\b|hrs\b|mah\b)'))"
_NOISE = _LINES + "n AS (SELECT *, " + _SMALL + r""" AS small, CASE WHEN body = '' OR """ + _SMALL + r""" THEN NULL
 WHEN regexp_matches(body, '(?i)^open media [0-9]+ in modal$') THEN 'shopify_ui_fragment' WHEN regexp_matches(body, '(?i)^[0-9]+\s*/\s*of\s*[0-9]+$') THEN 'page_counter' WHEN regexp_matches(body, '^- [0-9]+$') THEN 'numeric_list_debris'
 WHEN regexp_matches(body, '(?i)^- [a-z]{1,4}$') THEN 'short_list_debris' WHEN body IN ('-', 'i', 'g', '(B)') AND token_count <= 2 THEN 'single_token_debris' WHEN token_count <= 5 AND regexp_matches(body, '(?i)^[IVXLC0-9+\s=\-]+$') THEN 'ocr_roman_numeral_debris' END AS reason FROM n0),
nn AS (SELECT *, CASE reason WHEN 'shopify_ui_fragment' THEN 0.98 WHEN 'page_counter' THEN 0.95 WHEN 'numeric_list_debris' THEN 0.95 WHEN 'short_list_debris' THEN 0.9 WHEN 'single_token_debris' THEN 0.95 WHEN 'ocr_roman_numeral_debris' THEN 0.88 ELSE 0 END::DOUBLE AS confidence,
 CASE WHEN reason = 'page_counter' THEN 'context_noise' ELSE 'standalone_low_value' END AS category FROM n) """
_PARTS = " ".join(f"WHEN contains(lower({of}), '{part}') THEN '{reason}'" for of, parts in (("url", corpus.URL_PARTS), ("title", corpus.TITLE_PARTS), ("text", corpus.UI_TEXTS)) for part, reason in parts)
_RED = "coalesce(text, '')"
for _pattern, _new in (tx.REDACTIONS[0], *tx.REDACTIONS):
    _RED = f"regexp_replace({_RED}, '{_pattern}', '{_new.replace('$', chr(92))}', 'g')"

ORACLE_SQL = {
    "document_identity_uuid5": _U + ", h AS (SELECT page_id, website, sha1(unhex('" + urls.DNS + "') || encode(lower(website) || ':' || normalised)) AS h FROM u) SELECT page_id, website, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS document_id FROM h",
    "sentence_split": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[ \t\n\v\f\r]+([A-Z0-9"(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, unnest(s) AS text, (generate_subscripts(s, 1) - 1)::INT AS sentence FROM s""",
    "dup_content_hash": _H + "SELECT content_hash, count(*) AS n, min(doc_id) AS first, count(*) AS several FROM h GROUP BY 1 HAVING count(*) > 1",
    "dup_cross_source": _H + "SELECT content_hash, count(*) AS n, min(doc_id) AS first, count(DISTINCT source) AS several FROM h GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "dup_first_kept": _H + "SELECT doc_id, content_hash, row_number() OVER w = 1 AS kept, CASE WHEN row_number() OVER w > 1 THEN first(doc_id) OVER w END AS duplicate_of FROM h WINDOW w AS (PARTITION BY content_hash ORDER BY doc_id)",
    "dup_suppressed_report": _H + "SELECT duplicate_of, count(*) AS n_suppressed FROM (SELECT row_number() OVER w AS k, first(doc_id) OVER w AS duplicate_of FROM h WINDOW w AS (PARTITION BY content_hash ORDER BY doc_id)) WHERE k > 1 GROUP BY 1",
    "url_normalize": _U + "SELECT * FROM u", "dup_url_alias": _U + "SELECT normalised, count(*) AS n, min(page_id) AS first, count(*) AS several FROM u GROUP BY 1 HAVING count(*) > 1",
    "dup_query_param": _U + "SELECT normalised, count(*) AS n, min(page_id) AS first, count(DISTINCT url) AS several FROM u GROUP BY 1 HAVING count(DISTINCT url) > 1",
    "website_counts": _U + "SELECT website, count(*) AS n_pages, count(DISTINCT normalised) AS n_documents FROM u GROUP BY 1",
    "html_clean_retention": f"WITH t AS (SELECT page_id, html, {_CLEAN} AS text FROM pages), r AS (SELECT *, CASE WHEN length(html) = 0 THEN 0 ELSE round_even(length(text)::DOUBLE / length(html), 4) END AS retention FROM t) SELECT page_id, length(html) AS n_html, length(text) AS n_text, sha256(text) AS text_sha256, retention, CASE WHEN retention >= 0.9 THEN 'high' WHEN retention >= 0.5 THEN 'medium' WHEN retention >= 0.1 THEN 'low' ELSE 'minimal' END AS bucket FROM r",
    "extract_links": r"""WITH l AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a href="([^"]*)">', 1) AS u, regexp_extract_all(coalesce(html, ''), '<a href="[^"]*">([^<]*)</a>', 1) AS t FROM pages),
      e AS (SELECT page_id, unnest(u) AS url, unnest(t) AS label, generate_subscripts(u, 1) AS pos FROM l WHERE len(u) = len(t)), f AS (SELECT page_id, url, arg_min(label, pos) AS label FROM e GROUP BY ALL)
      SELECT * FROM f WHERE lower(trim(label)) NOT IN (""" + ", ".join(f"'{x}'" for x in corpus.NAVIGATION) + ")",
    "repeated_lines": "SELECT document_id, line, count(*) AS n FROM (SELECT doc_id AS document_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents) WHERE line <> '' GROUP BY ALL HAVING count(*) >= 2",
    "token_counts": "SELECT doc_id, " + _EST.format("text") + " AS token_estimate, " + _W.format("coalesce(text, '')") + " AS words, greatest(1, " + _W.format("coalesce(text, '')") + r") AS words_at_least_one, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g')) AS meaningful FROM documents",
    "noise_classify": _NOISE + "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, max(confidence) AS confidence FROM nn GROUP BY 1",
    "chunk_gate": _NOISE + r""", e AS (SELECT *, CASE WHEN trim(content) = '' THEN 'empty_content' WHEN token_count > 512 THEN 'token_limit_exceeded' WHEN document_id IS NULL OR website IS NULL THEN 'missing_provenance' WHEN regexp_matches(content, '(?i)sha256:[a-f0-9]{64}') THEN 'pipeline_metadata_leak'
      WHEN confidence >= 0.85 THEN 'noise:' || category WHEN regexp_matches(body, '(?i)^Page\s*\|\s*[0-9]+$') THEN 'page_counter' WHEN length(body) < 40 AND regexp_matches(body, '^[A-Z0-9][A-Z0-9\s&,\-./():''"]{2,60}$') AND token_count < 8 THEN 'heading_only' END AS early FROM nn),
      s AS (SELECT *, early IS NULL AND row_number() OVER (PARTITION BY document_id, early IS NULL, trim(regexp_replace(lower(content), '[ \t\n\r\f\v]+', ' ', 'g')) ORDER BY chunk_index) > 1 AS seen FROM e),
      g AS (SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN seen THEN 'duplicate:SAME_CONTEXT_DUPLICATE' WHEN regexp_matches(lower(content), 'left blank|by order of the board|all rights reserved') AND length(body) < 120 THEN 'boilerplate'
        WHEN regexp_matches(lower(content), 'skip to product information|you may also like') AND token_count < 25 THEN 'navigation_ui' WHEN token_count <= 3 AND NOT small THEN 'tiny_meaningless_fragment' WHEN regexp_matches(body, '(?i)^within (seven|ten|[0-9]+) (calendar )?days\.?$') THEN 'insufficient_context'
        WHEN token_count < 8 AND NOT small THEN 'small_chunk_needs_review' ELSE '' END AS reason2 FROM s)
      SELECT document_id, CASE WHEN reason2 = '' THEN 'EMBED_READY' WHEN reason2 IN ('insufficient_context', 'small_chunk_needs_review') THEN 'REVIEW' ELSE 'DO_NOT_EMBED' END AS status, reason2 AS reason, count(*) AS n, min(chunk_index) AS first FROM g GROUP BY ALL""",
    "eligibility_gate": rf"WITH t AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, {_CLEAN} AS text FROM pages), m AS (SELECT *, length(regexp_replace(text, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS n, (length(text) - length(replace(text, '](http', ''))) / 6 AS k FROM t), r AS (SELECT page_id, CASE {_PARTS} WHEN n < 80 THEN 'INSUFFICIENT_CONTENT' WHEN n < 200 AND k >= 5 THEN 'NAVIGATION_ONLY' END AS reason FROM m) SELECT page_id, CASE WHEN reason IS NULL THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS status, reason FROM r",
    "document_issues": r"SELECT doc_id, unnest(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END, CASE WHEN length(coalesce(text, '')) < 20 THEN 'short' END, CASE WHEN length(text) > 0 AND len(regexp_extract_all(text, '\p{L}'))::DOUBLE / length(text) < 0.15 THEN 'few_letters' END, CASE WHEN contains(text, chr(65533)) THEN 'replacement_character' END, CASE WHEN regexp_matches(text, '[\x00-\x08\x0E-\x1F]') THEN 'control_character' END], lambda x: x IS NOT NULL)) AS issue FROM documents",
    "gate_vs_labels": r"SELECT CASE WHEN length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}_]', '', 'g')) < 250 THEN 'REVIEW' ELSE 'ELIGIBLE' END AS status, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    "redact_pii": f"WITH r AS (SELECT doc_id, {_RED} AS t FROM documents) SELECT doc_id, " + ", ".join(rf"len(regexp_extract_all(t, '\[{m}\]')) AS n_{m}" for m in ("phone", "email", "api_key")) + ", sha256(t) AS redacted_sha256 FROM r",
    "manifest_counts": "SELECT 'lang' AS dimension, coalesce(lang, '') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, ''), count(*) FROM documents GROUP BY ALL",
    "corpus_diff_fingerprint": r"WITH c AS (SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'))) AS h FROM documents WHERE lang <> 'es'), p AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT doc_id, CASE WHEN c.h IS NULL THEN 'missing' WHEN p.h IS NULL THEN 'new' WHEN p.h <> c.h THEN 'modified' ELSE 'same' END AS state FROM p FULL JOIN c USING (doc_id)",
    "largest_remainder_alloc": "WITH w AS (SELECT o_orderpriority, count(*) AS w FROM orders GROUP BY 1), s AS (SELECT o_orderpriority, w * 1000 / sum(w) OVER () AS share FROM w), b AS (SELECT *, floor(share) AS base, round_even(share - floor(share), 9) AS part FROM s) SELECT o_orderpriority, (base + CASE WHEN row_number() OVER (ORDER BY part DESC, o_orderpriority) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS n FROM b",
}
