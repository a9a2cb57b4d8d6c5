"""Registered evaluation and history queries. A vector is relevant to a query of its own label; ten vectors in a row are
a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, history, retrieval
from ..sources import scratch
from ..sources.tables import table
from . import retrieval_queries as rq


def _hits(spark, root, k=20, dims=None):
    q, v = rq.vectors(spark, root)
    cut = (lambda c: F.slice(c, 1, dims)) if dims else (lambda c: F.col(c))
    found = retrieval.cosine_topk(q.select("query_id", cut("query").alias("query")), v.select("chunk_id", cut("vector").alias("vector")), k + 1).where("query_id <> chunk_id")
    return retrieval.first(found, k)


def _stored_hits(spark, root, k=20, dims=None):
    """The hits as a table, for what meets them with their own expected: the vectors are compared once."""
    return scratch.written(_hits(spark, root, k, dims), "hits")


def _expected(spark, root):
    v = table(spark, root, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return q, v


def _relevant(spark, root, hits):
    """The expected among the hits: those of the query's label. Only hits are joined, never all pairs."""
    q, v = _expected(spark, root)
    labels = v.select(F.col("vec_id").alias("chunk_id"), "label")
    return hits.join(labels, "chunk_id").join(q, "query_id").where("own = label").select("query_id", "chunk_id")


def _first(spark, root, dims=None):
    hits = _stored_hits(spark, root, 20, dims)
    return evaluation.first_ranks(hits, _relevant(spark, root, hits), _expected(spark, root)[0])


def recall_mrr(spark, root):
    return evaluation.summary(evaluation.measured(_first(spark, root)))


def by_category(spark, root):
    rows = evaluation.measured(_first(spark, root)).join(_expected(spark, root)[0], "query_id")
    return evaluation.summary(rows.withColumnRenamed("own", "category"), "category")


def compare_versions(spark, root):
    """All 64 dimensions against the first 32."""
    return evaluation.compared(_first(spark, root), _first(spark, root, 32))


def rank_details(spark, root):
    hits = _stored_hits(spark, root)
    return evaluation.rank_details(hits, _relevant(spark, root, hits))


def top_competing(spark, root):
    hits = _stored_hits(spark, root)
    return evaluation.competing(hits, _relevant(spark, root, hits)).select("query_id", "chunk_id", "score", "rank", "place")


def _evidence(spark, root, hits):
    """Hits whose text holds the question's whole text, both in small letters with single spaces."""
    texts = retrieval.rows_of(hits, rq.corpus(spark, root)).select("chunk_id", tx.match_text(F.col("text")).alias("t"))
    asked = rq.questions(spark, root).select("query_id", tx.match_text(F.col("query")).alias("q"))
    return hits.join(texts, "chunk_id").join(asked, "query_id").where(F.contains("t", "q")).select("query_id", "chunk_id")


def rerank_delta(spark, root):
    raw, new = rq.both(spark, root)[0], rq.reranked(spark, root)
    asked = rq.questions(spark, root)
    return evaluation.rank_change(evaluation.first_ranks(raw, _evidence(spark, root, raw), asked), evaluation.first_ranks(new, _evidence(spark, root, new), asked))


def root_causes(spark, root):
    """Expected are the vectors of the query's label in its document."""
    hits = _hits(spark, root, 100)
    q, v = _expected(spark, root)
    doc = lambda c: F.floor(F.col(c) / 10)
    wanted = q.withColumn("doc", doc("query_id")).join(v.withColumn("doc", doc("vec_id")), "doc").where("own = label and vec_id <> query_id").select("query_id", F.col("vec_id").alias("chunk_id"))
    n = wanted.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    in_document = hits.where(doc("chunk_id") == doc("query_id")).groupBy("query_id").agg(F.min("rank").alias("document_rank"))
    rows = evaluation.first_ranks(hits, wanted, q).join(n, "query_id", "left").join(in_document, "query_id", "left")
    return evaluation.zero_filled(rows.withColumn("cause", evaluation.root_cause(F.coalesce("n_expected", F.lit(0)), F.col("rank"), F.col("document_rank"))), "cause", evaluation.ROOT_CAUSES)


def latency_percentiles(spark, root):
    return evaluation.nearest_rank(table(spark, root, "events").withColumn("run", F.lit("all")), "value", (50, 90, 95, 99), "run")


def latency_by_bucket(spark, root):
    return evaluation.nearest_rank(table(spark, root, "events"), "value", (50, 90, 95, 99), "event_type")


def failure_clusters(spark, root):
    """Errors of the trace: their payload's number modulo 5 is the pattern, modulo 3 the product, the user the
    conversation."""
    e = table(spark, root, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k % 5 == 0, "RETRIEVAL_FAILURE").when(k % 5 == 1, "TOOL_FAILURE").otherwise("UNLISTED_FAILURE")
    rows = e.where("event_type = 'error'").select(kind.alias("failure_type"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("pattern"), F.col("user_id").alias("conversation_id"), (k % 3).alias("product"))
    total = e.agg(F.count_distinct("user_id").alias("total"))
    clusters = evaluation.failure_clusters(rows, 1).drop("percentage").crossJoin(F.broadcast(total))  # one row
    return clusters.select("cluster_id", "failure_type", "pattern", "n_conversations", "n_turns", F.bround(100.0 * F.col("n_conversations") / F.col("total"), 2).alias("percentage"), "common_product", "severity")


def _turns(spark, root):
    return table(spark, root, "conversations")


def latest_turn(spark, root):
    return history.latest_turns(_turns(spark, root)).select("conv_id", "turn", "role", "n_turns", F.sha2("text", 256).alias("text_sha256"))


def conversation_detail(spark, root):
    return history.details(_turns(spark, root))


def conversation_messages(spark, root):
    return history.messages(_turns(spark, root))


def history_last6(spark, root):
    return history.compacted(_turns(spark, root))


def guardrail_flags(spark, root):
    return _turns(spark, root).select("conv_id", "turn", F.coalesce(tx.guardrail(F.col("text")), F.lit("pass")).alias("guardrail"))


def detect_language(spark, root):
    return _turns(spark, root).select("conv_id", "turn", tx.script_language(F.col("text")).alias("language"))


def phone_extract(spark, root):
    """The first valid mobile number of each document's digit runs."""
    spans = F.regexp_extract_all(tx.filled(F.col("text")), F.lit(r"\+?[0-9][0-9 \-()]{8,}[0-9]"), F.lit(0))
    found = F.filter(F.transform(spans, tx.mobile_number), lambda x: x.isNotNull())
    return table(spark, root, "documents").select("doc_id", F.size(spans).alias("n_spans"), F.try_element_at(found, F.lit(1)).alias("phone"))


def idle_sessions(spark, root):
    rows = history.idle_sessions(table(spark, root, "events").select("event_id", "user_id", "ts"), "user_id", "ts")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


def ttl_dedup(spark, root):
    e = table(spark, root, "events").select("event_id", "user_id", "event_type", "ts")
    return history.first_claims(e, ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


def status_page(spark, root):
    rows = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return history.status_page(rows, "O", "o_orderstatus", [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 100).select("o_orderkey", "o_custkey", "o_totalprice")


def closer_labels(spark, root):
    """Orders with the name of their customer, who may be unknown, by status."""
    names = table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(names, "o_custkey", "left")
    return rows.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", F.coalesce("c_name", F.lit("unknown")).alias("closed_by"))


QUERIES = {
    "eval_recall_mrr": recall_mrr, "eval_by_category": by_category, "eval_compare_versions": compare_versions, "eval_rank_details": rank_details, "eval_top_competing": top_competing,
    "eval_rerank_delta": rerank_delta, "root_cause_histogram": root_causes, "latency_percentiles": latency_percentiles, "latency_by_bucket": latency_by_bucket, "failure_clusters": failure_clusters,
    "latest_turn_per_conversation": latest_turn, "conversation_detail": conversation_detail, "conversation_messages": conversation_messages, "history_last6": history_last6, "guardrail_flags": guardrail_flags, "detect_language": detect_language,
    "phone_extract": phone_extract, "idle_sessions": idle_sessions, "ttl_dedup": ttl_dedup, "status_page": status_page, "closer_labels": closer_labels,
}

_E = """WITH s AS (SELECT q.vec_id AS query_id, q.label AS own, e.vec_id AS chunk_id, e.label, round_even(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score,
    round_even(list_cosine_similarity(q.embedding[:32]::DOUBLE[], e.embedding[:32]::DOUBLE[]), 6) + 0.0 AS score2 FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
  h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY score2 DESC, chunk_id) AS rank2 FROM s),
  q AS (SELECT DISTINCT query_id, own FROM s), f AS (SELECT q.query_id, q.own, (SELECT min(rank) FROM h WHERE h.query_id = q.query_id AND label = h.own AND rank <= 20) AS r, (SELECT min(rank2) FROM h WHERE h.query_id = q.query_id AND label = h.own AND rank2 <= 20) AS r2 FROM q) """
_SUM = ", ".join(f"round_even(avg(CASE WHEN r <= {k} THEN 1 ELSE 0 END), 4) AS recall_at_{k}" for k in evaluation.CUTS) + ", round_even(avg(coalesce(1::DOUBLE / r, 0)), 4) AS mrr, count(*) AS total, count(*) FILTER (r <= 10) AS passed"
_PCT = ", ".join(f"round_even((list(value ORDER BY value))[round_even({p / 100}::DOUBLE * (count(*) - 1), 0)::INT + 1], 3) AS p{p}" for p in (50, 90, 95, 99))
_EV = rq._BASE + """, m AS (SELECT item_id AS query_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS q FROM benchmark), x AS (SELECT doc_id AS chunk_id, trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents),
  a AS (SELECT query_id, min(rank) AS a FROM bm JOIN x USING (chunk_id) JOIN m USING (query_id) WHERE contains(t, q) GROUP BY 1), b AS (SELECT query_id, min(rank) AS b FROM rr JOIN x USING (chunk_id) JOIN m USING (query_id) WHERE contains(t, q) GROUP BY 1) """
ORACLE_SQL = {
    "eval_recall_mrr": _E + f"SELECT {_SUM} FROM f", "eval_by_category": _E + f"SELECT own AS category, {_SUM} FROM f GROUP BY own",
    "eval_compare_versions": _E + "SELECT query_id, r AS baseline_rank, r2 AS candidate_rank, r - r2 AS rank_delta, CASE WHEN NOT coalesce(r <= 10, false) AND coalesce(r2 <= 10, false) THEN 'newly_passed' WHEN coalesce(r <= 10, false) AND NOT coalesce(r2 <= 10, false) THEN 'newly_failed' ELSE 'unchanged' END AS change FROM f",
    "eval_rank_details": _E + "SELECT query_id, count(*) AS n_found, min(rank) AS best_rank, arg_min(score, rank) AS best_score, count(*) FILTER (rank <= 10) AS in_top_10, count(*) FILTER (rank <= 20) AS in_top_20 FROM h WHERE label = own AND rank <= 20 GROUP BY 1",
    "eval_top_competing": _E + "SELECT query_id, chunk_id, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM h WHERE label <> own AND rank <= 20 QUALIFY place <= 5",
    "eval_rerank_delta": _EV + "SELECT item_id AS query_id, a AS raw_rank, b AS reranked_rank, a - b AS rank_delta, CASE WHEN a IS NOT NULL AND b IS NULL THEN 'regressed' WHEN b < a THEN 'improved' WHEN b > a THEN 'regressed' ELSE 'unchanged' END AS status FROM benchmark LEFT JOIN a ON a.query_id = item_id LEFT JOIN b ON b.query_id = item_id",
    "root_cause_histogram": _E + ", w AS (SELECT query_id, count(*) FILTER (label = own) AS n, min(rank) FILTER (rank <= 100 AND label = own) AS c, min(rank) FILTER (rank <= 100) AS d FROM h WHERE chunk_id // 10 = query_id // 10 GROUP BY 1), g AS (SELECT q.query_id, coalesce(n, 0) AS n, c, d FROM q LEFT JOIN w USING (query_id)), k AS (SELECT CASE WHEN c <= 10 THEN NULL WHEN n = 0 THEN 'EVALUATION_MAPPING' WHEN d IS NULL THEN 'CORPUS_GAP' WHEN d <= 10 THEN CASE WHEN n > 3 THEN 'CHUNK_FRAGMENTATION' ELSE 'EXPECTED_DOCUMENT_WRONG_CHUNK' END WHEN d <= 100 THEN 'RETRIEVAL_COMPETITION' ELSE 'UNRESOLVED' END AS label FROM g) SELECT l.label, count(k.label) AS n FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in evaluation.ROOT_CAUSES) + "]) AS label) l LEFT JOIN k USING (label) GROUP BY 1",
    "latency_percentiles": f"SELECT 'all' AS run, count(*) AS n, {_PCT} FROM events WHERE value IS NOT NULL", "latency_by_bucket": f"SELECT event_type, count(*) AS n, {_PCT} FROM events WHERE value IS NOT NULL GROUP BY 1",
    "failure_clusters": """WITH e AS (SELECT user_id, json_extract_string(props, '$.k')::INT AS k FROM events WHERE event_type = 'error'), r AS (SELECT CASE k % 5 WHEN 0 THEN 'RETRIEVAL_FAILURE' WHEN 1 THEN 'TOOL_FAILURE' ELSE 'UNLISTED_FAILURE' END AS failure_type, 'p' || (k % 5) AS pattern, user_id, k % 3 AS product FROM e),
      p AS (SELECT failure_type, pattern, product, count(*) AS c FROM r GROUP BY ALL), b AS (SELECT failure_type, pattern, product FROM p QUALIFY row_number() OVER (PARTITION BY failure_type, pattern ORDER BY c DESC, product) = 1)
      SELECT failure_type || '::' || pattern AS cluster_id, failure_type, pattern, count(DISTINCT user_id) AS n_conversations, count(*) AS n_turns, round_even(100::DOUBLE * count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 2) AS percentage, any_value(b.product) AS common_product,
      CASE failure_type WHEN 'RETRIEVAL_FAILURE' THEN 60 WHEN 'TOOL_FAILURE' THEN 85 ELSE 20 END AS severity FROM r JOIN b USING (failure_type, pattern) GROUP BY failure_type, pattern""",
    "latest_turn_per_conversation": "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS n_turns, sha256(text) AS text_sha256 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "conversation_detail": "SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, substring(arg_min(text, turn), 1, 40) AS opening FROM conversations GROUP BY 1",
    "conversation_messages": "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS n_turns, text FROM conversations",
    "history_last6": "SELECT conv_id, turn, role, substring(trim(text), 1, 250) AS content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6",
    "guardrail_flags": r"SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(lower(t), '" + "|".join(tx.INJECTION) + r"') THEN 'prompt_injection' WHEN contains(lower(t), 'kill yourself') THEN 'unsupported' WHEN length(t) > 4000 THEN 'too_long' ELSE 'pass' END AS guardrail FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations)",
    "detect_language": r"SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^\+?[0-9][0-9\s\-()]{6,}[0-9]$') THEN NULL WHEN regexp_matches(t, '[ऀ-ॿ]') AND regexp_matches(t, '[A-Za-z]') THEN 'hinglish' WHEN regexp_matches(t, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' END AS language FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations)",
    "phone_extract": r"WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\+?[0-9][0-9 \-()]{8,}[0-9]') AS spans FROM documents) SELECT doc_id, len(spans) AS n_spans, list_filter(list_transform(spans, lambda x: regexp_extract(regexp_replace(x, '[^0-9]', '', 'g'), '^(?:0|91)?([6-9][0-9]{9})$', 1)), lambda x: x <> '')[1] AS phone FROM s",
    "idle_sessions": "WITH i AS (SELECT event_id, user_id, ts, coalesce(round_even((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6::DOUBLE, 3) >= 900, false)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS session FROM i) SELECT user_id, session::BIGINT AS session, count(*) AS n_events, min(event_id) AS first_event FROM s GROUP BY ALL",
    "ttl_dedup": "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, ts FROM events), c AS (SELECT * FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1) UNION ALL SELECT * FROM (SELECT e.* FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.ts >= c.ts + INTERVAL 24 HOUR QUALIFY row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts, e.event_id) = 1)) SELECT event_id, user_id, event_type FROM c",
    "status_page": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100",
    "closer_labels": "SELECT o_orderkey, o_orderstatus, coalesce(c_name, 'unknown') AS closed_by FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'O'",
}
