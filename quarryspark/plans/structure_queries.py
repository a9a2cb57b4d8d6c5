"""Registered queries of blocks and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks, evaluation, evidence, fusion, hierarchy
from ..sources.tables import table
from . import evaluation_queries as eq
from . import retrieval_queries as rq
from .corpus_queries import _CLEAN


def _blocks(spark, root):
    return blocks.markdown_blocks(table(spark, root, "documents").select("doc_id", "text"))


def markdown_blocks(spark, root):
    return _blocks(spark, root).select("document_id", "ord", "node_type", "level", "section", "n_lines", F.sha2("text", 256).alias("text_sha256"))


def structure_counts(spark, root):
    return blocks.structure_counts(_blocks(spark, root))


def content_consistency(spark, root):
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return blocks.coverage(docs, blocks.plain_text(_blocks(spark, root)))


def fact_evidence(spark, root):
    """Of each question's keyword hits, those that hold it as a fact."""
    texts = rq.corpus(spark, root).select("chunk_id", tx.match_text(F.col("text")).alias("t"))
    hits = rq.keyword(spark, root).join(texts, "chunk_id").join(rq.questions(spark, root), "query_id")
    return hits.where(evidence.fact_matches(F.col("query"), F.col("t"))).groupBy("query_id").agg(F.count("*").alias("n_hits"), F.min("rank").alias("first_rank"))


def needle_resolution(spark, root):
    asked = rq.questions(spark, root).select("query_id", evidence.needles(F.col("query")).alias("needles"))
    hits = rq.bm25(spark, root).select("query_id", "chunk_id").join(rq.corpus(spark, root), "chunk_id")
    return evidence.best_by_needles(hits, asked)


def compare_lists(spark, root):
    """The first evidence in both lists and in their merge, and where it got lost."""
    asked, (v, k) = rq.questions(spark, root), rq.both(spark, root)
    rank = lambda hits, name: evaluation.first_ranks(hits, eq._evidence(spark, root, hits), asked).withColumnRenamed("rank", name)
    rows = rank(v, "vector_rank").join(rank(k, "keyword_rank"), "query_id").join(rank(fusion.current_merge(v, k), "merged_rank"), "query_id")
    return rows.withColumn("locus", evidence.locus(F.col("vector_rank"), F.col("keyword_rank"), F.col("merged_rank")))


def vector_validation(spark, root):
    rows = table(spark, root, "embeddings").select("vec_id", evidence.vector_issues(F.col("embedding"), 64).alias("i"))
    return rows.select(F.when(F.size("i") == 0, "valid").otherwise(F.array_join("i", ",")).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


def embedding_inputs(spark, root):
    """The input of each page's embedding: title, kind, path of its URL, text."""
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    path = F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    given = tx.embedding_input(F.lit("web_page"), title, path, tx.tidy(tx.without_markup(F.col("html"))))
    return table(spark, root, "pages").select("page_id", F.length(given).alias("n"), F.sha2(given, 256).alias("input_sha256"))


def _units(spark, root):
    titles = table(spark, root, "documents").select(F.col("doc_id").alias("document_id"), F.concat(F.lit("Corpus "), "source").alias("title"))
    return hierarchy.units(_blocks(spark, root), titles)


def semantic_units(spark, root):
    return _units(spark, root).select("document_id", "ord", "node_type", F.array_join("path", " > ").alias("path"), F.sha2("text", 256).alias("text_sha256"))


def whole_units(spark, root):
    return hierarchy.whole_units(_units(spark, root)).select("document_id", "ord", "token_count", F.sha2("content", 256).alias("content_sha256"))


def hierarchical_chunks(spark, root):
    rows = hierarchy.hierarchical_chunks(_units(spark, root))
    return rows.select("document_id", "chunk_index", "method", "token_count", F.sha2("content", 256).alias("content_sha256"))


def hierarchical_tails(spark, root):
    return hierarchy.tail_merges(hierarchy.hierarchical_chunks(_units(spark, root)))


QUERIES = {
    "semantic_units": semantic_units, "whole_units": whole_units, "hierarchical_chunks": hierarchical_chunks, "hierarchical_tails": hierarchical_tails,
    "markdown_blocks": markdown_blocks, "structure_counts": structure_counts, "content_consistency": content_consistency, "fact_evidence": fact_evidence, "needle_resolution": needle_resolution,
    "fusion_compare_lists": compare_lists, "vector_validation": vector_validation, "embedding_input_hash": embedding_inputs,
}

_B = r"""WITH l AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT *, trim(line) AS own, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^\|(.+)\|$') THEN 'table' WHEN regexp_matches(trim(line), '^#{1,6}\s+.+$') AND NOT contains(trim(line), '![') THEN 'heading' WHEN regexp_matches(line, '^\s*[*\-]\s+.+$') THEN 'list' ELSE 'paragraph' END AS kind FROM l),
i AS (SELECT *, CASE WHEN kind = 'list' THEN length(regexp_extract(line, '^(\s*)', 1)) ELSE 0 END AS indent, CASE WHEN kind = 'heading' THEN length(regexp_extract(own, '^(#+)', 1)) END AS level,
  CASE kind WHEN 'heading' THEN trim(regexp_replace(own, '^#+\s+', '')) WHEN 'list' THEN trim(regexp_replace(own, '^[*\-]\s+', '')) ELSE own END AS content FROM k),
n AS (SELECT *, coalesce(kind <> lag(kind) OVER w OR kind = 'heading' OR indent <> lag(indent) OVER w, false)::INT AS new, last_value(CASE WHEN level <= 2 THEN content END IGNORE NULLS) OVER w AS section FROM i WINDOW w AS (PARTITION BY document_id ORDER BY pos)),
o AS (SELECT *, sum(new) OVER (PARTITION BY document_id ORDER BY pos) AS ord FROM n),
b AS (SELECT document_id, ord::BIGINT AS ord, any_value(kind) AS node_type, max(level) AS level, any_value(section) AS section, count(*) AS n_lines, string_agg(content, chr(10) ORDER BY pos) AS text FROM o WHERE kind <> 'blank' GROUP BY document_id, ord) """
_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]{{3,}}'))"
_UNITS = _B + ", un AS (SELECT b.document_id, ord, node_type, b.text, list_filter(['Corpus ' || source, trim(section)], lambda p: coalesce(p, '') <> '') AS path FROM b JOIN documents ON doc_id = b.document_id WHERE node_type <> 'heading') "
ORACLE_SQL = {
    "semantic_units": _UNITS + "SELECT document_id, ord, node_type, array_to_string(path, ' > ') AS path, sha256(text) AS text_sha256 FROM un",
    "whole_units": _UNITS + r", ub AS (SELECT *, regexp_replace(regexp_replace(text, '(?i)sha256:[a-f0-9]{64}', '', 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS body, CASE WHEN len(path) > 1 THEN array_to_string(path, ' > ') END AS context FROM un), uc AS (SELECT document_id, ord, CASE WHEN context IS NULL OR starts_with(body, context) THEN body ELSE context || chr(10) || chr(10) || body END AS content FROM ub WHERE body <> ''), ud AS (SELECT *, greatest(1, floor(length(content) / 4.0::DOUBLE + 0.999::DOUBLE))::BIGINT AS token_count FROM uc) SELECT document_id, ord, token_count, sha256(content) AS content_sha256 FROM ud WHERE token_count <= 150",
    "embedding_input_hash": rf"WITH p AS (SELECT page_id, trim(regexp_extract(html, '<title>(.*?)</title>', 1, 's')) AS title, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg, trim({_CLEAN}) AS text FROM pages), i AS (SELECT page_id, CASE WHEN title <> '' THEN 'Document: ' || title || chr(10) ELSE '' END || 'Type: Web Page' || CASE WHEN len(seg) > 0 THEN chr(10) || 'Section: ' || array_to_string(seg[-3:], ' > ') ELSE '' END || chr(10) || chr(10) || text AS x FROM p) SELECT page_id, length(x) AS n, sha256(x) AS input_sha256 FROM i",
    "markdown_blocks": _B + "SELECT document_id, ord, node_type, level, section, n_lines, sha256(text) AS text_sha256 FROM b",
    "structure_counts": _B + "SELECT document_id, count(*) FILTER (node_type = 'heading') AS headings, count(*) FILTER (node_type = 'list') AS lists, count(*) FILTER (node_type = 'table') AS tables, count(*) FILTER (node_type = 'paragraph') AS paragraphs, count(*) FILTER (node_type = 'paragraph' AND length(text) >= 400) AS giants, count(*) FILTER (node_type = 'heading') - count(DISTINCT text) FILTER (node_type = 'heading') AS repeated_headings FROM b GROUP BY 1",
    "content_consistency": _B + ", p AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM b GROUP BY 1), w AS (SELECT p.document_id, " + _WORDS.format("d.text") + " AS a, " + _WORDS.format("p.text") + " AS b FROM p JOIN documents d ON d.doc_id = p.document_id) SELECT document_id, CASE WHEN len(a) = 0 THEN 1 ELSE round_even(len(list_intersect(a, b))::DOUBLE / len(a), 4) END AS share FROM w",
    "fact_evidence": rq._BASE + r""", x AS (SELECT kw.query_id, rank, m.text AS fact, trim(regexp_replace(lower(coalesce(m.text, '')), '[ \t\n\r\f\v]+', ' ', 'g')) AS q, trim(regexp_replace(lower(coalesce(d.text, '')), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM kw JOIN documents d ON d.doc_id = chunk_id JOIN benchmark m ON m.item_id = query_id)
      SELECT query_id, count(*) AS n_hits, min(rank) AS first_rank FROM x WHERE contains(t, q) OR CASE WHEN contains(fact, '|') THEN len(list_filter(string_split(fact, '|'), lambda p: trim(p) <> '' AND contains(t, lower(trim(p))))) > 0 WHEN contains(fact, '/') THEN len(list_filter(string_split(fact, '/'), lambda p: trim(p) <> '' AND contains(t, lower(trim(p))))) > 0
        ELSE len(list_filter(regexp_extract_all(q, '[a-z0-9]{5,}'), lambda p: contains(t, p))) > 0 END GROUP BY 1""",
    "needle_resolution": rq._BASE + r""", x AS (SELECT bm.query_id, chunk_id, trim(regexp_replace(lower(d.text), '[ \t\n\r\f\v]+', ' ', 'g')) AS t, list_filter(list_transform(string_split_regex(m.text, '[.!?;\n]+'), lambda s: trim(s)), lambda s: length(s) >= 20) AS needles FROM bm JOIN documents d ON d.doc_id = chunk_id JOIN benchmark m ON m.item_id = query_id),
      y AS (SELECT query_id, chunk_id, len(list_filter(needles, lambda s: contains(t, trim(regexp_replace(lower(s), '[ \t\n\r\f\v]+', ' ', 'g'))))) AS n FROM x) SELECT query_id, chunk_id, n FROM y WHERE n > 0 QUALIFY n = max(n) OVER (PARTITION BY query_id)""",
    "fusion_compare_lists": rq._BASE + r""", x AS (SELECT doc_id AS chunk_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents), m AS (SELECT item_id AS query_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\f\v]+', ' ', 'g')) AS q FROM benchmark),
      e1 AS (SELECT query_id, min(rank) AS r FROM bm JOIN x USING (chunk_id) JOIN m USING (query_id) WHERE contains(t, q) GROUP BY 1), e2 AS (SELECT query_id, min(rank) AS r FROM kw JOIN x USING (chunk_id) JOIN m USING (query_id) WHERE contains(t, q) GROUP BY 1), e3 AS (SELECT query_id, min(ord) AS r FROM cap JOIN x USING (chunk_id) JOIN m USING (query_id) WHERE contains(t, q) AND ord <= 10 GROUP BY 1)
      SELECT m.query_id, e1.r AS vector_rank, e2.r AS keyword_rank, e3.r AS merged_rank, CASE WHEN e1.r IS NOT NULL AND e3.r IS NULL THEN 'merge_only' WHEN e1.r IS NULL AND e2.r IS NULL THEN 'absent_from_both_pools' WHEN e1.r IS NULL THEN 'keyword_only' ELSE 'vector_has_it' END AS locus FROM m LEFT JOIN e1 USING (query_id) LEFT JOIN e2 USING (query_id) LEFT JOIN e3 USING (query_id)""",
    "vector_validation": "WITH i AS (SELECT CASE WHEN len(embedding) <> 64 THEN 'length' WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-3 THEN 'norm' ELSE 'valid' END AS state FROM embeddings) SELECT state, count(*) AS n FROM i GROUP BY 1",
}
