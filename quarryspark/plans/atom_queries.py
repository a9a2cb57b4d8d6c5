"""Registered queries of atomic units and of chunks behind their filters. A document's lines are marked by its kind first: as
questions, named values, bullets, contacts, clauses or as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import atoms, hierarchy
from ..sources.tables import table
from . import structure_queries as sq


def _units(spark, root):
    d = F.col("doc_id") % 6
    bare = lambda x, n: F.trim(F.translate(F.left(x, F.lit(n)), "?.:", ""))

    def line(x, i):
        n = (i + 1).cast("string")
        return F.when(d == 0, F.concat(n, F.lit(".1 Ask "), bare(x, 40), F.lit("? It is "), bare(x, 60))).when(d == 1, F.concat(F.lit("Item "), n, F.lit(": "), bare(x, 50))).when(d == 2, F.concat(F.lit("- "), bare(x, 30))).when(d == 3, F.concat(F.lit("Contact us "), n, F.lit(" "), x)).otherwise(x)

    kind = F.when(d == 4, "clause").when(d == 5, "semantic").otherwise("paragraph")
    lines = F.transform(F.split("text", "\n"), line)
    text = F.when(d == 5, F.array_join(lines, "\n\n")).otherwise(F.array_join(lines, "\n"))
    return table(spark, root, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ord"), kind.alias("unit_type"), F.array(F.col("lang"), F.col("source")).alias("path"), text.alias("text"))


def atomic_units(spark, root):
    return atoms.atoms(_units(spark, root)).select("document_id", "k", "atom_type", F.array_join("path", " > ").alias("path"), F.sha2("content", 256).alias("content_sha256"), "part")


def enforced_units(spark, root):
    found = atoms.enforced(atoms.atoms(_units(spark, root)))
    return found.select("document_id", "k", "i", "atom_type", "token_count", F.sha2("content", 256).alias("content_sha256"), "part")


def filtered_chunks(spark, root):
    """The chunks along the structure that stay, numbered anew."""
    kept = hierarchy.filtered(hierarchy.hierarchical_chunks(sq._units(spark, root)))[0]
    return kept.select("document_id", "chunk_index", "chunk_id", "method", "token_count")


def suppressed_chunks(spark, root):
    gone = hierarchy.filtered(hierarchy.hierarchical_chunks(sq._units(spark, root)))[1]
    return gone.select("document_id", "chunk_index", "method", "token_count", "reason", "confidence", F.left("detail", F.lit(20)).alias("detail"))


QUERIES = {"atomic_units": atomic_units, "enforced_units": enforced_units, "filtered_chunks": filtered_chunks, "suppressed_chunks": suppressed_chunks}

_BARE = lambda n: f"trim(translate(left(x, {n}), '?.:', ''))"
_BL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
ORACLE_SQL = {
    "atomic_units": f"""WITH l AS (SELECT doc_id, doc_id % 6 AS d, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n, lang, source FROM documents),
m AS (SELECT *, CASE d WHEN 0 THEN n || '.1 Ask ' || {_BARE(40)} || '? It is ' || {_BARE(60)} WHEN 1 THEN 'Item ' || n || ': ' || {_BARE(50)} WHEN 2 THEN '- ' || {_BARE(30)} WHEN 3 THEN 'Contact us ' || n || ' ' || x ELSE x END AS y FROM l),
u AS MATERIALIZED (SELECT doc_id, any_value(d) AS d, any_value(lang) AS lang, any_value(source) AS source, CASE WHEN any_value(d) = 5 THEN string_agg(y, chr(10) || chr(10) ORDER BY n) ELSE string_agg(y, chr(10) ORDER BY n) END AS text FROM m GROUP BY doc_id),
q AS (SELECT doc_id, lang, x.n AS g1, x.q AS g2, trim(x.a, {_BL}) AS g3, row_number() OVER (PARTITION BY doc_id ORDER BY x.k) - 1 AS k FROM (SELECT doc_id, lang, unnest(list_transform(range(2, len(p) + 1), lambda i: {{'k': i, 'n': string_split(p[i], chr(2))[1], 'q': string_split(string_split(p[i], chr(2))[2], chr(3))[1], 'a': string_split(p[i], chr(3))[2]}})) AS x FROM (SELECT doc_id, lang, string_split(regexp_replace(text, '(\\d+\\.\\d+)\\s+([^?]+\\?)\\s+', chr(1) || '\\1' || chr(2) || '\\2' || chr(3), 'g'), chr(1)) AS p FROM u)) WHERE trim(x.a, {_BL}) <> ''),
c AS (SELECT doc_id FROM u WHERE contains(lower(text), 'customer support') OR contains(lower(text), 'contact us') OR contains(lower(text), 'reach us') OR contains(lower(text), 'phone') OR contains(lower(text), 'email')),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k, a, b FROM (SELECT doc_id, n, trim(regexp_extract(y, '^([A-Za-z][A-Za-z0-9 /\\-]+):\\s*(.+)$', 1)) AS a, trim(regexp_extract(y, '^([A-Za-z][A-Za-z0-9 /\\-]+):\\s*(.+)$', 2)) AS b FROM m WHERE d = 1) WHERE len(list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')) >= 2),
sn AS (SELECT doc_id FROM m WHERE d = 1 AND regexp_matches(y, '^([A-Za-z][A-Za-z0-9 /\\-]+):\\s*(.+)$') GROUP BY 1 HAVING count(*) >= 2),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS k, trim(regexp_extract(trim(y), '^[-\\x{{2022}}*]\\s+(.+)$', 1)) AS t FROM m WHERE d = 2 AND regexp_matches(trim(y), '^[-\\x{{2022}}*]\\s+(.+)$')),
r AS (SELECT u.*, CASE WHEN doc_id IN (SELECT doc_id FROM q) THEN 'faq' WHEN doc_id IN (SELECT doc_id FROM c) THEN 'contact' WHEN doc_id IN (SELECT doc_id FROM s) AND doc_id IN (SELECT doc_id FROM sn) THEN 'spec' WHEN d = 4 THEN 'clause' WHEN (SELECT count(*) FROM b WHERE b.doc_id = u.doc_id) >= 3 THEN 'bullets' ELSE 'whole' END AS rule FROM u WHERE trim(text, {_BL}) <> '')
SELECT doc_id AS document_id, k, 'faq_pair' AS atom_type, lang || ' > FAQ ' || g1 AS path, sha256('Question: ' || trim(g2, {_BL}) || chr(10) || chr(10) || 'Answer: ' || g3) AS content_sha256, 'faq:' || g1 AS part FROM q UNION ALL
SELECT s.doc_id, k, 'product_specification', lang || ' > ' || source, sha256(a || ': ' || b), 'spec:' || a FROM s JOIN r USING (doc_id) WHERE rule = 'spec' UNION ALL
SELECT b.doc_id, k, 'product_feature', lang || ' > ' || source, sha256(t), 'bullet:' || k FROM b JOIN r USING (doc_id) WHERE rule = 'bullets' UNION ALL
SELECT doc_id, 0, CASE rule WHEN 'contact' THEN 'contact_information' WHEN 'clause' THEN 'policy_clause' ELSE 'paragraph' END, lang || ' > ' || source, sha256(trim(text, {_BL})), '' FROM r WHERE rule IN ('contact', 'clause', 'whole')""",
}
