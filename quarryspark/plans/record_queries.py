"""Registered queries of records, anchors, Markdown clean-up and table replacements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus, evidence, history, records
from ..sources import store
from ..sources.tables import table


def merged_contexts(spark, root):
    """What each user last did for sure: the last type of an event of value, and its value."""
    e = table(spark, root, "events").select("user_id", "event_id", F.when(F.col("value") >= 10, F.col("event_type")).alias("kind"), F.when(F.col("event_type") != "click", F.col("value")).alias("amount"))
    return records.merged_context(e, "user_id", "event_id", ["kind", "amount"])


def resolved_sources(spark, root):
    """Sources that orders name: beginnings of customer names, one of them unknown."""
    key = F.col("c_custkey").cast("string")
    allowed = F.array(F.concat(F.lit("c"), key), F.concat(F.lit("d"), key))
    returned = F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("c"), key, F.lit("#4")), F.lit("x"))).when(F.col("c_custkey") % 3 == 1, F.array(F.concat(F.lit(" d"), key), F.concat(F.lit("d"), key))).otherwise(F.array(F.lit("?")))
    return table(spark, root, "customer").select("c_custkey", F.array_join(records.resolved_sources(returned, allowed), ",").alias("sources"))


def redacted_maps(spark, root):
    m = F.create_map(F.lit("Name"), F.col("source"), F.lit("text"), tx.filled(F.col("text")), F.lit("token"), F.lit(""))
    return table(spark, root, "documents").select("doc_id", records.redacted_map(m).alias("m")).select("doc_id", F.col("m")["Name"].alias("name"), F.sha2(F.col("m")["text"], 256).alias("text_sha256"), F.col("m")["token"].alias("token"))


def phone_keys(spark, root):
    spans = F.regexp_extract_all(tx.filled(F.col("text")), F.lit(r"\+?[0-9][0-9 \-()]{8,}[0-9]"), F.lit(0))
    return table(spark, root, "documents").select("doc_id", F.explode(spans).alias("raw")).groupBy(records.identity_of_phone(F.col("raw")).alias("key")).agg(F.count("*").alias("n"))


def chunk_reports(spark, root):
    return records.chunk_report(corpus.line_chunks(table(spark, root, "documents")).withColumn("website", F.coalesce("website", F.lit(""))), "website")


def json_artifacts(spark, root):
    """Each page as a JSON artifact, every one with a query in its URL cut short."""
    j = F.to_json(F.struct("url", F.length("html").alias("size")))
    rows = table(spark, root, "pages").select("page_id", F.when(F.contains("url", F.lit("?")), F.substring(j, 1, 12)).otherwise(j).alias("j"))
    return records.json_artifacts(rows, "j", "url string, size int")


def anchor_resolution(spark, root):
    """Each source's documents against an anchor: they hold the or der, hold no license, and are of a source of one digit."""
    anchor = F.struct(F.array(F.lit("License")).alias("exclude"), F.lit("src").alias("section_prefix"), F.array(F.lit(" A ")).alias("all_of"), F.array(F.lit("The "), F.lit("der ")).alias("any_of"))
    docs = table(spark, root, "documents")
    met = evidence.anchor_matches(F.lower(tx.filled(F.col("text"))), F.array(F.coalesce("source", F.lit(""))), anchor)
    return docs.where(met).groupBy("source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def markdown_cleaned(spark, root):
    return table(spark, root, "documents").select("doc_id", tx.without_empty_lines_of_markup(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("text_sha256"))


def json_objects(spark, root):
    """Events as a model would answer: with thoughts, in a fence, with words around, or broken."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("<think>{a}</think>"), "props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("It is "), "props", F.lit(" so"))).otherwise(F.lit("{broken"))
    return table(spark, root, "events").select("event_id", F.try_variant_get(evidence.json_object(said), "$.k", "int").alias("k"))


def replaced_vectors(spark, root):
    """Twenty vectors in turn are one document: documents with a vector of label 5 are replaced by those, of labels below."""
    v = table(spark, root, "embeddings").select("vec_id", "label", (F.col("vec_id") % 20).alias("document_id")).withColumn("chunk_index", F.lit(0))
    return store.replaced(v.where("label < 5"), v.where("label = 5"), "document_id", "vec_id").groupBy("label").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"))


def one_version(spark, root):
    rows = table(spark, root, "embeddings").select("vec_id", F.concat(F.lit("v"), F.col("label").cast("string")).alias("version"))
    return store.only_version(rows, "version", "v3").select("vec_id")


def users_page(spark, root):
    """The second hundred customers by number: a page is what is asked for."""
    return history.status_page(table(spark, root, "customer").select("c_custkey", "c_name"), None, "c_name", [F.asc("c_custkey")], 100, 100)


QUERIES = {
    "merged_contexts": merged_contexts, "resolved_sources": resolved_sources, "redacted_maps": redacted_maps, "phone_keys": phone_keys, "chunk_reports": chunk_reports,
    "json_artifacts": json_artifacts, "anchor_resolution": anchor_resolution, "markdown_cleaned": markdown_cleaned, "json_objects": json_objects, "replaced_vectors": replaced_vectors, "one_version": one_version,
    "users_page": users_page,
}

_TIDY = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t\v\f]+(\n|$)', '\1', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"
_RED = "coalesce(text, '')"
for _pattern, _new in (tx.REDACTIONS[0], *tx.REDACTIONS):
    _RED = f"regexp_replace({_RED}, '{_pattern}', '{_new.replace('$', chr(92))}', 'g')"
_SRC = _RED.replace("coalesce(text, '')", "source")
ORACLE_SQL = {
    "merged_contexts": "SELECT user_id, arg_max(event_type, event_id) FILTER (value >= 10) AS kind, arg_max(value, event_id) FILTER (event_type <> 'click' AND value IS NOT NULL) AS amount FROM events GROUP BY 1",
    "resolved_sources": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'c' || c_custkey WHEN 1 THEN 'd' || c_custkey ELSE 'c' || c_custkey || ',d' || c_custkey END AS sources FROM customer",
    "redacted_maps": f"SELECT doc_id, CASE WHEN source <> '' THEN '[redacted]' ELSE source END AS name, sha256({_RED}) AS text_sha256, '' AS token FROM documents",
    "phone_keys": r"WITH s AS (SELECT unnest(regexp_extract_all(coalesce(text, ''), '\+?[0-9][0-9 \-()]{8,}[0-9]')) AS raw FROM documents), d AS (SELECT regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM s), m AS (SELECT d, regexp_extract(d, '^(?:0|91)?([6-9][0-9]{9})$', 1) AS m FROM d) SELECT CASE WHEN m <> '' THEN '+91' || m ELSE '+' || d END AS key, count(*) AS n FROM m GROUP BY 1",
    "chunk_reports": r"WITH l AS (SELECT doc_id, coalesce(source, '') AS website, unnest(string_split(coalesce(text, ''), chr(10))) AS c FROM documents), t AS (SELECT *, CASE WHEN trim(regexp_replace(c, '[ \t\n\r\f\v]+', ' ', 'g')) = '' THEN 0 ELSE greatest(1, floor(length(c) / 4.0::DOUBLE + 0.999::DOUBLE))::BIGINT END AS n FROM l) SELECT website, count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, sum(n)::BIGINT AS tokens, min(n) AS least, max(n) AS most, count(*) FILTER (n < 30) AS n_small, count(*) FILTER (n > 150) AS n_large, round_even(sum(n)::DOUBLE / count(*), 4) AS mean FROM t GROUP BY 1",
    "json_artifacts": "SELECT page_id, CASE WHEN NOT contains(url, '?') THEN url END AS url, CASE WHEN NOT contains(url, '?') THEN length(html) END AS size, contains(url, '?') AS corrupt FROM pages",
    "anchor_resolution": "SELECT source, count(*) AS n, min(doc_id) AS first FROM documents WHERE NOT contains(lower(coalesce(text, '')), 'license') AND starts_with(trim(coalesce(source, '')), 'src') AND contains(lower(text), ' a ') AND (contains(lower(text), 'the ') OR contains(lower(text), 'der ')) GROUP BY 1",
    "markdown_cleaned": r"WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*(!\[[^\]]*\]\([^)]+\)|\[!\[[^\]]*\]\([^)]+\)\]\([^)]+\)|\[[ \t]*\]\([^)]+\))[ \t]*$')) AS l FROM documents), t AS (SELECT doc_id, " + _TIDY.format("array_to_string(l, chr(10))") + " AS t FROM l) SELECT doc_id, length(t) AS n_chars, sha256(t) AS text_sha256 FROM t",
    "json_objects": "SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN json_extract_string(props, '$.k')::INT END AS k FROM events",
    "replaced_vectors": "WITH v AS (SELECT vec_id, label, vec_id % 20 AS d FROM embeddings), n AS (SELECT label, row_number() OVER (PARTITION BY d ORDER BY vec_id) - 1 AS i FROM v WHERE label = 5), a AS (SELECT label, 0 AS i FROM v WHERE label < 5 AND d NOT IN (SELECT d FROM v WHERE label = 5) UNION ALL SELECT label, i FROM n) SELECT label, count(*) AS n, max(i)::INT AS last FROM a GROUP BY 1",
    "one_version": "SELECT vec_id FROM embeddings WHERE label = 3",
    "users_page": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100 OFFSET 100",
}
