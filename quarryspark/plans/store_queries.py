"""Registered queries of the repeatable writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import store
from ..sources.tables import table


def raw_append(spark, root):
    """English texts are stored; all documents come in: what is appended."""
    docs = table(spark, root, "documents").select("doc_id", "lang", tx.content_hash(F.col("text")).alias("content_hash"))
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return store.new_rows(docs.where("lang = 'en'"), first, ["content_hash"])


def url_index(spark, root):
    return store.url_index(store.raw_artifacts(table(spark, root, "pages")))


def upsert_identity(spark, root):
    """Vectors of label 0 are stored as run 1; all come in as run 2: the table after it, by run."""
    v = table(spark, root, "embeddings").select("vec_id", "label")
    return store.upserted(v.where("label = 0").withColumn("run", F.lit(1)), v.withColumn("run", F.lit(2)), ["vec_id"]).groupBy("run").agg(F.count("*").alias("n"))


def document_versions(spark, root):
    """A user's events are versions of a document, their type is its content."""
    e = table(spark, root, "events").select("user_id", "event_id", "event_type")
    return store.versions(e, "user_id", "event_id", "event_type").where("is_current").select("user_id", "event_id", "version")


QUERIES = {"raw_append_idempotent": raw_append, "raw_url_index": url_index, "upsert_identity": upsert_identity, "document_versions": document_versions}

from .corpus_queries import _U  # noqa: E402

ORACLE_SQL = {
    "raw_append_idempotent": "WITH h AS (SELECT doc_id, lang, 'sha256:' || sha256(coalesce(text, '')) AS content_hash FROM documents) SELECT content_hash, min(doc_id) AS doc_id FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE lang = 'en') GROUP BY 1",
    "raw_url_index": _U + "SELECT website, normalised AS canonical_url, count(DISTINCT h) AS n_versions, arg_max(h, page_id) AS latest_hash FROM (SELECT u.*, 'sha256:' || sha256(coalesce(html, '')) AS h FROM u JOIN pages USING (page_id)) GROUP BY ALL",
    "upsert_identity": "SELECT CASE WHEN label = 0 THEN 1 ELSE 2 END AS run, count(*) AS n FROM embeddings GROUP BY 1",
    "document_versions": "WITH c AS (SELECT user_id, event_id, coalesce(lag(event_type) OVER w <> event_type, false)::INT AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, max(event_id) AS event_id, (sum(c) + 1)::BIGINT AS version FROM c GROUP BY 1",
}
