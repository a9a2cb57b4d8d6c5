"""Registered queries of rendered documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks, rendering
from ..sources.tables import table
from .structure_queries import _B

#: What stands before the texts of every fifth document, so that headings repeat and lists and tables occur.
FRONT = "# Terms\n## terms\n- one\n-  \n- two\n# Part\n### Part\n### Part\n# Part\n| a | b |\n|---|---|\n| c |\n\n## a\n## Part\n\n"


def _given(spark, root):
    i = F.col("doc_id")
    return table(spark, root, "documents").select(i, "source", "lang", F.when(i % 5 == 0, F.concat(F.lit(FRONT), "text")).otherwise(F.col("text")).alias("text"))


def _documents(spark, root):
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("policy", "product", "webpage", "webpage", "faq"))), (i % 5 + 1).cast("int"))
    kind = F.when(i % 10 == 5, "webpage").when(i % 20 == 10, "product").when(i % 40 == 20, "faq").otherwise(kind)
    return _given(spark, root).select(
        i.alias("document_id"), F.concat(F.lit(" Terms  of "), F.coalesce("source", F.lit("")), F.when(i % 7 == 3, ".pdf").otherwise(" -")).alias("title"), F.when(i % 4 == 2, F.concat(F.lit("https://shop.example/products/m1x-own-"), "lang", F.lit("/"))).alias("url"),
        kind.alias("document_type"), F.when(i % 15 == 5, "pdf").otherwise("html").alias("source_type"),
    )


def _blocks(spark, root):
    page = F.when((F.col("document_id") % 3 == 1), F.floor(F.col("ord") / 6) + 1)
    return blocks.markdown_blocks(_given(spark, root).select("doc_id", "text")).withColumn("page", page)


def _digest(rows):
    return rows.select("document_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def rendered_texts(spark, root):
    """Documents of all types; those of questions are tested by faq_text."""
    docs = _documents(spark, root).where("document_type <> 'faq'")
    return _digest(rendering.rendered(docs, _blocks(spark, root)))


def structure_previews(spark, root):
    return _digest(rendering.preview(_blocks(spark, root)))


def glued_coverage(spark, root):
    """How many terms of each benchmark item the document with its number holds, the first terms glued to an article."""
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("content"))
    asked = table(spark, root, "benchmark").select("item_id", F.concat(F.lit("the aLA price "), "text").alias("query"))
    rows = asked.join(docs, "item_id").select("item_id", tx.lexical_coverage(F.col("query"), F.col("content"), ("la", "the")).alias("score"))
    return rows


QUERIES = {"rendered_texts": rendered_texts, "structure_previews": structure_previews, "glued_coverage": glued_coverage}

_FRONT = FRONT.replace("\n", "' || chr(10) || '")
_CELLS = r"list_transform(list_filter(string_split(text, chr(10)), lambda x, i: NOT (i = 2 AND regexp_matches(trim(x), '^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$'))), lambda x: array_to_string(list_transform(string_split(regexp_replace(trim(x), '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c)), ' | '))"
_TREE = _B.replace("FROM documents)", "FROM edited)").replace("WITH l AS", f"WITH edited AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN '{_FRONT}' || text ELSE text END AS text FROM documents), l AS", 1)
_SHOWN = rf""", d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 5 THEN 'webpage' WHEN doc_id % 20 = 10 THEN 'product' WHEN doc_id % 40 = 20 THEN 'faq' ELSE ['policy', 'product', 'webpage', 'webpage', 'faq'][doc_id % 5 + 1] END AS type, doc_id % 15 = 5 AS paper,
  rtrim('Terms of ' || coalesce(source, '') || CASE WHEN doc_id % 7 = 3 THEN '.pdf' ELSE ' -' END) AS title, CASE WHEN doc_id % 4 = 2 AND lang IS NOT NULL THEN 'M1X Own ' || upper(lang[1:1]) || lower(lang[2:]) END AS slug FROM edited),
x AS (SELECT document_id, ord, level, node_type, CASE WHEN document_id % 3 = 1 THEN ord // 6 + 1 END AS page, type, paper, title, node_type = 'heading' AND trim(text) <> '' AS head, CASE node_type WHEN 'list' THEN array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda v: trim(v) <> ''), lambda v: '- ' || trim(v)), chr(10)) WHEN 'table' THEN array_to_string({_CELLS}, chr(10)) ELSE trim(text) END AS part FROM b JOIN d ON doc_id = document_id WHERE type <> 'faq'),
oo AS (SELECT *, last_value(CASE WHEN head THEN part END IGNORE NULLS) OVER (PARTITION BY document_id, page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM x WHERE type <> 'policy'),
r AS (SELECT *, node_type = 'heading' AND coalesce(level, 1) <= 2 AS name FROM x WHERE type = 'policy' AND page IS NULL), s AS (SELECT *, sum(CASE WHEN name THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY ord) AS run FROM r),
t AS (SELECT document_id, min(ord) AS ord, CASE WHEN run = 0 THEN max(title) ELSE coalesce(max(part) FILTER (NOT name), '') END AS opener, run, coalesce(list(part ORDER BY ord) FILTER (name AND part <> ''), []) AS names FROM s GROUP BY document_id, run),
y AS (SELECT document_id, ord, run, string_split(list_reduce([opener] || names, lambda a, v: CASE WHEN contains(lower(string_split(a, chr(1))[-1]), lower(v)) THEN a ELSE a || chr(1) || v END), chr(1)) AS parts FROM t),
z AS (SELECT document_id, ord, 1 AS k, part FROM oo WHERE type = 'product' OR NOT head OR above IS NULL OR above <> part UNION ALL SELECT document_id, min(ord), 0, CASE WHEN type = 'product' THEN 'Page ' ELSE 'Page:' || chr(10) END || page FROM x WHERE type <> 'policy' AND page IS NOT NULL GROUP BY document_id, page, type
  UNION ALL SELECT document_id, ord, 1, array_to_string(list_filter(CASE WHEN run = 0 THEN parts[2:] ELSE parts END, lambda v: trim(v) <> ''), chr(10) || chr(10)) FROM y),
j AS (SELECT document_id, string_agg(part, chr(10) || chr(10) ORDER BY ord, k) AS body, bool_or(k = 0) AS pages FROM z WHERE trim(part) <> '' GROUP BY 1),
h AS (SELECT doc_id AS document_id, CASE WHEN type = 'product' THEN 'Product:' || chr(10) || coalesce(slug, CASE WHEN ends_with(title, '.pdf') THEN replace(title, '.pdf', '') ELSE trim(title, ' -–') END) WHEN type <> 'policy' AND (paper OR coalesce(pages, false)) THEN 'Document:' || chr(10) || title ELSE title END AS head, body FROM d LEFT JOIN j ON document_id = doc_id WHERE type <> 'faq'),
w AS (SELECT document_id, head || CASE WHEN coalesce(body, '') <> '' THEN chr(10) || chr(10) || body ELSE '' END AS text FROM h) """
ORACLE_SQL = {
    "rendered_texts": _TREE + _SHOWN + "SELECT document_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM w",
    "structure_previews": _TREE + f", ii AS (SELECT document_id, ord, list_filter(CASE node_type WHEN 'list' THEN string_split(text, chr(10)) WHEN 'table' THEN {_CELLS} ELSE [text] END, lambda v: trim(v) <> '') AS items FROM b), w AS (SELECT document_id, string_agg(array_to_string(items, chr(10) || chr(10)), chr(10) || chr(10) ORDER BY ord) AS text FROM ii WHERE len(items) > 0 GROUP BY 1) SELECT document_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM w",
    "glued_coverage": r"""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(regexp_replace(lower('the aLA price ' || text), '(^|[^\p{L}\p{N}_])a(la|the)($|[^\p{L}\p{N}_])', '\1a \2\3', 'g'), '[a-z0-9]+'), lambda v: v NOT IN (STOP))) AS terms FROM benchmark),
h AS (SELECT item_id, terms, regexp_extract_all(lower(coalesce(d.text, '')), '[a-z0-9]+') AS own FROM q JOIN documents d ON doc_id = item_id) SELECT item_id, CASE WHEN len(terms) = 0 THEN 0 ELSE round_even(len(list_filter(terms, lambda v: list_contains(own, v) OR (v = 'price' AND list_has_any(own, ['mrp', 'cost'])) OR (v = 'cost' AND list_has_any(own, ['mrp', 'price'])) OR (v = 'mrp' AND list_has_any(own, ['price', 'cost']))))::DOUBLE / len(terms), 6) END AS score FROM h""".replace("STOP", ", ".join(f"'{x}'" for x in tx.STOP_WORDS)),
}
