"""Registered queries of knowledge in blocks and chunks, and of the stores around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import corpus, knowledge
from ..sources import store
from ..sources.tables import table
from .corpus_queries import _U, _docs, _hashed, dup_content_hash, dup_cross_source, dup_query_param, dup_url_alias
from .structure_queries import _B, _blocks


def faq_text(spark, root):
    titles = _docs(spark, root).select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"))
    return knowledge.faq_text(_blocks(spark, root), titles).select("document_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def sanitized_text(spark, root):
    return _docs(spark, root).select("doc_id", knowledge.sanitized(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def _lines(spark, root):
    """Lines as chunks; ten in a row have the same path, each source is a label."""
    return corpus.line_chunks(_docs(spark, root)).where("trim(content) <> ''").withColumn("path", F.floor(F.col("chunk_index") / 10)).withColumn("label", F.col("website"))


def document_repeats(spark, root):
    return knowledge.document_repeats(_lines(spark, root))


def suppressed_repeats(spark, root):
    found = knowledge.suppressed(_lines(spark, root), ["src1", "src2"])
    return found.groupBy("kept").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_documents"))


def suppressed_across(spark, root):
    found = knowledge.suppressed(_lines(spark, root), ["src1", "src2"], cross_document=True)
    return found.groupBy("document_id").agg(F.count_if(~F.col("kept")).alias("n_suppressed"), F.count("*").alias("n"))


def question_coverage(spark, root):
    """Each question is looked for in the lines of the document with its number, by its first words of five letters."""
    words = F.slice(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)), 1, 2)
    asked = table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("document_id"), words.alias("needles"))
    return knowledge.question_coverage(asked, corpus.line_chunks(_docs(spark, root)))


def empty_blocks(spark, root):
    return knowledge.empty_blocks(_blocks(spark, root)).groupBy("node_type").agg(F.count("*").alias("n"))


def dup_pdf_url(spark, root):
    """Contents that several URLs of numbered papers give."""
    papers = table(spark, root, "pages").where(F.col("url").rlike(r"/[0-9]+([?#]|$)")).select("page_id", urls.normalised(F.col("url")).alias("canonical_url"), F.sha2(F.regexp_extract("html", '<html lang="([a-z]*)"', 1), 256).alias("raw_hash"))
    return corpus.duplicate_groups(papers, ["raw_hash"], "page_id", "canonical_url")


def duplicate_summary(spark, root):
    """The single reports together."""
    return knowledge.duplicate_summary(content=dup_content_hash(spark, root), cross_source=dup_cross_source(spark, root), url_alias=dup_url_alias(spark, root), query_param=dup_query_param(spark, root))


def page_slugs(spark, root):
    hashed = tx.content_hash(F.col("html"))
    return table(spark, root, "pages").select("page_id", urls.slug(F.col("url")).alias("slug"), urls.hash_filename(hashed).alias("file"))


def artifacts_by_hash(spark, root):
    """Documents whose content some Spanish document has too."""
    hashed = _hashed(spark, root)
    wanted = _docs(spark, root).where("lang = 'es'").select(tx.content_hash(F.col("text")).alias("content_hash"))
    return store.by_hash(hashed, wanted).select("doc_id", "content_hash")


def second_versions(spark, root):
    e = table(spark, root, "events").select("user_id", "event_id", "event_type")
    return store.at_version(store.versions(e, "user_id", "event_id", "event_type"), 2).select("user_id", "event_id")


def without_excluded(spark, root):
    """Vectors of documents that are not toxic, by label."""
    gone = table(spark, root, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return store.without(table(spark, root, "embeddings").select("vec_id", "label"), gone, "vec_id").groupBy("label").agg(F.count("*").alias("n"))


def vectors_exist(spark, root):
    """Which documents have a vector."""
    return store.present(table(spark, root, "embeddings"), _docs(spark, root).select(F.col("doc_id").alias("vec_id")), ["vec_id"])


def status_changes(spark, root):
    """Orders after their customers of the first nation set them done."""
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    names = table(spark, root, "customer").where("c_nationkey = 1").select(F.col("c_custkey").alias("o_custkey"))
    changes = orders.join(names, "o_custkey", "left_semi").select("o_orderkey", F.lit("F").alias("status"), F.col("o_custkey").alias("changed_by"))
    return store.with_status(orders, changes, "o_orderkey").groupBy("status", "changed").agg(F.count("*").alias("n"))


def corpus_manifest(spark, root):
    return store.corpus_manifest(_docs(spark, root).select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", tx.filled(F.col("text")).alias("text")), "source", "doc_id", "text")


QUERIES = {
    "faq_text": faq_text, "sanitized_text": sanitized_text, "document_repeats": document_repeats, "suppressed_repeats": suppressed_repeats, "suppressed_across": suppressed_across, "question_coverage": question_coverage,
    "empty_blocks": empty_blocks, "dup_pdf_url": dup_pdf_url, "duplicate_summary": duplicate_summary, "page_slugs": page_slugs, "artifacts_by_hash": artifacts_by_hash, "second_versions": second_versions,
    "without_excluded": without_excluded, "vectors_exist": vectors_exist, "status_changes": status_changes, "corpus_manifest": corpus_manifest,
}

_L = r"WITH l AS (SELECT doc_id AS document_id, source AS label, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents), c AS (SELECT *, i // 10 AS path, trim(regexp_replace(lower(content), '[ \t\n\r\f\v]+', ' ', 'g')) AS key, trim(content) AS own FROM l WHERE trim(content) <> '') "
_PLACE = "CASE label WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END"
_HASH = "WITH h AS (SELECT doc_id, lang, source, 'sha256:' || sha256(coalesce(text, '')) AS h FROM documents) "
ORACLE_SQL = {
    "faq_text": _B + r""", kk AS (SELECT *, trim(text) AS own, node_type = 'heading' AND ends_with(trim(text), '?') AS asks FROM b WHERE node_type IN ('heading', 'paragraph', 'list') AND NOT (node_type = 'paragraph' AND regexp_matches(text, '(?i)Q[0-9]+\.[ \t\n\r\f\v]+[^\n]'))),
      g AS (SELECT *, lag(CASE WHEN asks THEN own END) OVER (PARTITION BY document_id ORDER BY ord) AS asked, CASE WHEN node_type = 'list' THEN array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: '- ' || trim(x)), chr(10)) ELSE own END AS t FROM kk),
      p AS (SELECT document_id, ord, CASE WHEN asks THEN NULL WHEN asked IS NOT NULL THEN CASE WHEN trim(t) <> '' THEN 'Question:' || chr(10) || rtrim(asked, '?') || '?' || chr(10) || chr(10) || 'Answer:' || chr(10) || trim(t) END WHEN node_type = 'heading' THEN NULL
        WHEN node_type = 'paragraph' AND starts_with(upper(own), 'Q') AND instr(own, '?') BETWEEN 1 AND 120 THEN CASE WHEN trim(substring(own, instr(own, '?') + 1)) <> '' THEN 'Question:' || chr(10) || rtrim(trim(left(own, instr(own, '?'))), '?') || '?' || chr(10) || chr(10) || 'Answer:' || chr(10) || trim(substring(own, instr(own, '?') + 1)) END ELSE t END AS part FROM g),
      j AS (SELECT document_id, string_agg(part, chr(10) || chr(10) ORDER BY ord) AS text FROM p WHERE trim(part) <> '' GROUP BY 1), f AS (SELECT doc_id AS document_id, coalesce(j.text, trim(coalesce(d.source, ''))) AS text FROM documents d LEFT JOIN j ON j.document_id = d.doc_id)
      SELECT document_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM f""",
    "sanitized_text": r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '!\[[^\]]*\]\([^)]+\)', '', 'g'), '(?m)^#{1,6}[ \t]+', '', 'g') AS t FROM documents),
      b AS (SELECT doc_id, unnest(string_split(t, chr(10) || chr(10))) AS block, generate_subscripts(string_split(t, chr(10) || chr(10)), 1) AS i FROM a),
      l AS (SELECT doc_id, i, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS j FROM b), s AS (SELECT doc_id, i, j, regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS line FROM l),
      k AS (SELECT doc_id, i, j, trim(regexp_replace(regexp_replace(line, '\[([^\]]+)\]\(https?://[^)]+\)', '\1', 'g'), '(?i)sha256:[a-f0-9]{64}', '', 'g')) AS line FROM s WHERE line <> '' AND NOT (starts_with(line, '- [') AND contains(line, '](http'))),
      m AS (SELECT doc_id, i, string_agg(line, chr(10) ORDER BY j) AS block FROM k WHERE line <> '' AND NOT regexp_matches(line, '(?i)^(name\*?|email\*?|phone number\*?|your city/zip/pin code|comment|send|send message|message us|drop us message for any query|contact form|let.s get in touch|skip to content|add to cart|filter and sort|taxes and shipping calculated at checkout)$') GROUP BY ALL),
      f AS (SELECT doc_id, trim(string_agg(block, chr(10) || chr(10) ORDER BY i)) AS t FROM m GROUP BY 1) SELECT d.doc_id, length(coalesce(t, '')) AS n_chars, sha256(coalesce(t, '')) AS text_sha256 FROM documents d LEFT JOIN f USING (doc_id)""",
    "document_repeats": _L + r", f AS (SELECT *, min(i) OVER w AS first, first_value(path) OVER (PARTITION BY document_id, key ORDER BY i) AS first_path FROM c WINDOW w AS (PARTITION BY document_id, key)) SELECT document_id, i::INT AS chunk_index, first::INT AS duplicate_of, CASE WHEN regexp_matches(content, '(?i)(left blank|by order of the board|make in india|all rights reserved)') THEN 'BOILERPLATE' WHEN path = first_path THEN 'SAME_CONTEXT_DUPLICATE' WHEN length(own) >= 40 OR contains(own, '.') OR contains(own, ':') THEN 'DIFFERENT_CONTEXT_REPEAT' WHEN regexp_matches(own, '^[A-Z0-9][A-Z0-9 \t\n\r\f\v&,\-./():''\x22]{2,80}$') OR length(own) < 35 OR contains(lower(content), 'you may also like') THEN 'DUPLICATE_HEADING' ELSE 'DIFFERENT_CONTEXT_REPEAT' END AS class FROM f WHERE i > first",
    "suppressed_repeats": _L + f", r AS (SELECT document_id, length(key) < 40 OR row_number() OVER (PARTITION BY document_id, path, key ORDER BY {_PLACE}, document_id, i) = 1 AS kept FROM c) SELECT kept, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM r GROUP BY 1",
    "suppressed_across": _L + f", r AS (SELECT document_id, length(key) < 40 OR row_number() OVER (PARTITION BY path, key ORDER BY {_PLACE}, document_id, i) = 1 AS kept FROM c) SELECT document_id, count(*) FILTER (NOT kept) AS n_suppressed, count(*) AS n FROM r GROUP BY 1",
    "question_coverage": r"WITH q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z]{5,}')[:2] AS needles FROM benchmark), l AS (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM documents), h AS (SELECT query_id, len(needles) AS n, len(list_filter(needles, lambda v: contains(coalesce(line, ''), v))) AS here, len(needles) > 0 AND contains(coalesce(line, ''), needles[1]) AS a, len(needles) > 1 AND contains(coalesce(line, ''), needles[2]) AS b FROM q LEFT JOIN l ON l.doc_id = q.query_id) SELECT query_id, n::INT AS n_needles, (bool_or(a)::INT + bool_or(b)::INT)::BIGINT AS n_held, max(here) = n AS single_chunk, bool_or(a)::INT + bool_or(b)::INT = n AS covered FROM h GROUP BY query_id, n",
    "empty_blocks": _B + "SELECT node_type, count(*) AS n FROM b WHERE trim(coalesce(text, '')) = '' GROUP BY 1",
    "dup_pdf_url": _U + r", p AS (SELECT page_id, normalised, sha256(regexp_extract(html, '<html lang=\x22([a-z]*)\x22', 1)) AS raw_hash FROM u JOIN pages USING (page_id) WHERE regexp_matches(pages.url, '/[0-9]+([?#]|$)')) SELECT raw_hash, count(*) AS n, min(page_id) AS first, count(DISTINCT normalised) AS several FROM p GROUP BY 1 HAVING count(DISTINCT normalised) > 1",
    "duplicate_summary": _U + ", hh AS (SELECT source, sha256(coalesce(text, '')) AS h FROM documents), ga AS (SELECT count(*) AS n, count(DISTINCT source) AS s FROM hh GROUP BY h), gb AS (SELECT count(*) AS n, count(DISTINCT url) AS s FROM u GROUP BY normalised) SELECT 'content' AS kind, count(*) AS n_groups, coalesce(sum(n), 0)::BIGINT AS n_items FROM ga WHERE n > 1 UNION ALL SELECT 'cross_source', count(*), coalesce(sum(n), 0)::BIGINT FROM ga WHERE s > 1 UNION ALL SELECT 'url_alias', count(*), coalesce(sum(n), 0)::BIGINT FROM gb WHERE n > 1 UNION ALL SELECT 'query_param', count(*), coalesce(sum(n), 0)::BIGINT FROM gb WHERE s > 1",
    "page_slugs": r"SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), 'www.', ''), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'crawl') AS slug, 'sha256_' || sha256(coalesce(html, '')) || '.json' AS file FROM pages",
    "artifacts_by_hash": _HASH + "SELECT doc_id, h AS content_hash FROM h WHERE h IN (SELECT h FROM h WHERE lang = 'es')",
    "second_versions": "WITH c AS (SELECT user_id, event_id, coalesce(lag(event_type) OVER w <> event_type, false)::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), v AS (SELECT user_id, event_id, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) + 1 AS v FROM c) SELECT user_id, event_id FROM v WHERE v = 2",
    "without_excluded": "SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) GROUP BY 1",
    "vectors_exist": "SELECT doc_id AS vec_id, count(vec_id) AS n, count(vec_id) > 0 AS exists FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY 1",
    "status_changes": "WITH o AS (SELECT o_orderstatus AS old, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1) AS c FROM orders) SELECT CASE WHEN c THEN 'F' ELSE old END AS status, c AND old <> 'F' AS changed, count(*) AS n FROM o GROUP BY ALL",
    "corpus_manifest": "SELECT coalesce(source, '') AS source, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, sum(('0x' || left(sha256(coalesce(text, '')), 12))::BIGINT)::HUGEINT::VARCHAR AS fingerprint FROM documents GROUP BY 1",
}
