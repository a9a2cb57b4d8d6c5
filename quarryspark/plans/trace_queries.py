"""Registered queries of traces. A trace of a turn is made as JSON from each event: its key k says what happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import traces
from ..sources.tables import dealt_out, table


def made(spark, root) -> DataFrame:
    """(trace_id, trace): one trace for each event."""
    k, v, i = F.col("k"), F.col("value"), F.col("event_id")
    hits = lambda n, score: F.transform(F.filter(F.array(*map(F.lit, range(1, 4))), lambda x: x <= n), lambda x: F.struct(F.concat(F.lit("c"), (i % 50 + x).cast("string")).alias("chunk_id"), F.concat(F.lit("d"), x.cast("string")).alias("document_id"), x.alias("rank"), (1 / x).alias(score), F.array(F.lit("a"), x.cast("string")).alias("section_path")))
    chunks = F.transform(F.filter(F.array(F.lit(1), F.lit(2)), lambda x: x <= k % 3), lambda x: F.struct(F.concat(F.lit("c"), (i % 50 + x).cast("string")).alias("chunk_id"), (x + 1).alias("position"), F.lit("p. 1").alias("section"), F.lit("text").alias("text"), (1 / x).alias("score")))
    trace = F.struct(
        F.struct(F.col("user_id").alias("conversation_id"), F.col("event_type").alias("user_message")).alias("request"),
        F.struct((k % 4 == 0).alias("rewrite_executed"), F.when(k % 8 == 0, F.lit(" ")).when(k % 4 == 0, F.col("event_type")).alias("rewritten_query")).alias("query"),
        F.struct(F.when(k % 3 != 1, "KNOWLEDGE").otherwise("CHAT").alias("turn_intent"), (k % 5 != 1).alias("needs_rag"), F.when(k % 2 == 0, "llm").otherwise("rule").alias("method")).alias("turn_understanding"),
        F.struct((k % 17 == 0).alias("blocked")).alias("guardrail"),
        F.struct(F.lit("hybrid").alias("backend"), F.lit("asked").alias("retrieval_query"), F.struct((v * 2).alias("vector_ms"), v.alias("keyword_ms")).alias("timings"), hits(k % 4, "vector_score").alias("vector"), hits(k % 2, "keyword_score").alias("keyword"), hits(k % 4, "combined_score").alias("merged"), hits(k % 4, "score").alias("candidates")).alias("retrieval"),
        F.struct((k % 6 != 0).alias("enabled"), F.lit("idf").alias("name"), F.reverse(hits(k % 4, "score")).alias("candidates")).alias("reranking"), F.struct(chunks.alias("chunks")).alias("final_context"),
        F.struct(F.when(k % 7 != 0, "m").alias("model"), (k % 3).alias("llm_call_count"), F.when(k % 9 != 0, "out").alias("raw_output")).alias("generation"),
        F.struct((k % 10 != 0).alias("validator_result"), F.when(k % 10 == 0, "llm_ungrounded").when(k % 11 == 0, "invalid_json").when(k % 13 == 0, "empty_hits").otherwise("ok").alias("validator_reason"), (k % 19 == 0).alias("fallback_triggered")).alias("grounding"),
        F.struct(F.when(k % 12 == 0, "ticket").alias("tool_name"), F.when(k % 12 == 0, k % 24 == 0).alias("success"), v.alias("latency_ms")).alias("tool_execution"),
        F.struct(F.when(k % 14 != 0, "Answer").alias("final_response")).alias("response"), F.struct(v.alias("total_ms"), (v / 2).alias("router_ms")).alias("latency"),
    )
    # the key is a column of its own, so it is read once a row
    rows = dealt_out(table(spark, root, "events"), "event_id").select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.select(F.concat(F.lit("t"), i.cast("string")).alias("trace_id"), trace.alias("trace"))


def _parsed(spark, root):
    """Traces are made as JSON and parsed again in the same task: as files they are some hundred times the events."""
    return traces.parsed(made(spark, root).select("trace_id", F.to_json("trace").alias("trace"))).select("trace_id", "t")


def trace_turns(spark, root):
    found = traces.turn_fields(_parsed(spark, root))
    return found.select(*[F.bround(c, 6).alias(c) if c.endswith("_ms") else c for c in found.columns])


def trace_hits(spark, root):
    found = traces.layer_hits(_parsed(spark, root)).drop("title", "original_retrieval_rank")
    return found.select(*[F.bround(c, 6).alias(c) if c.endswith("_score") else c for c in found.columns])


def trace_layers(spark, root):
    return traces.by_layer(traces.layer_hits(_parsed(spark, root)))


def trace_calls(spark, root):
    rows = _parsed(spark, root).select("trace_id", traces.llm_calls(F.col("t")).alias("c"), traces.insufficient(F.col("t"), "no information").alias("insufficient"))
    return rows.select("trace_id", "c.generation", "c.query_rewrite", "c.router", "c.total", "insufficient")


def trace_first_failures(spark, root):
    return _parsed(spark, root).groupBy(traces.first_failure(F.col("t")).alias("step")).agg(F.count("*").alias("n"))


QUERIES = {"trace_turns": trace_turns, "trace_hits": trace_hits, "trace_layers": trace_layers, "trace_calls": trace_calls, "trace_first_failures": trace_first_failures}

_K = "WITH e AS (SELECT 't' || event_id AS trace_id, event_id AS i, user_id, event_type, value AS v, json_extract_string(props, '$.k')::INT AS k FROM events) "
_H = _K + """, x AS (SELECT unnest([1, 2, 3]) AS x), hits AS (
  SELECT trace_id, 'vector' AS layer, x AS rank, i % 50 + x AS c, x, round_even(1::DOUBLE / x, 6) AS vector_score, NULL::DOUBLE AS keyword_score, NULL::DOUBLE AS rerank_score, NULL::DOUBLE AS combined_score FROM e JOIN x ON x <= k % 4
  UNION ALL SELECT trace_id, 'keyword', x, i % 50 + x, x, NULL, round_even(1::DOUBLE / x, 6), NULL, NULL FROM e JOIN x ON x <= k % 2
  UNION ALL SELECT trace_id, 'merged', x, i % 50 + x, x, NULL, NULL, NULL, round_even(1::DOUBLE / x, 6) FROM e JOIN x ON x <= k % 4
  UNION ALL SELECT trace_id, 'reranked', x, i % 50 + x, x, NULL, NULL, round_even(1::DOUBLE / x, 6), round_even(1::DOUBLE / x, 6) FROM e JOIN x ON x <= k % 4
  UNION ALL SELECT trace_id, 'final', x + 1, i % 50 + x, NULL, NULL, NULL, round_even(1::DOUBLE / x, 6), round_even(1::DOUBLE / x, 6) FROM e JOIN x ON x <= least(2, k % 3)) """
ORACLE_SQL = {
    "trace_turns": _K + "SELECT trace_id, user_id::VARCHAR AS conversation_id, event_type AS user_message, CASE WHEN k % 8 = 0 THEN ' ' WHEN k % 4 = 0 THEN event_type ELSE 'asked' END AS rewritten_query, CASE WHEN k % 3 <> 1 THEN 'KNOWLEDGE' ELSE 'CHAT' END AS intent, CASE WHEN k % 14 = 0 THEN '' ELSE 'Answer' END AS response, CASE WHEN k % 12 = 0 THEN 'ticket' END AS tool_name, CASE WHEN k % 12 = 0 THEN k % 24 = 0 END AS tool_success, NULL::VARCHAR AS lead_id, NULL::VARCHAR AS ticket_id, 'hybrid' AS backend, 'idf' AS reranker_name, NULL::DOUBLE AS guardrail_ms, round_even(v / 2, 6) AS routing_ms, NULL::DOUBLE AS rewrite_ms, NULL::DOUBLE AS retrieval_ms, NULL::DOUBLE AS generation_ms, round_even(v, 6) AS tool_ms, round_even(v, 6) AS total_ms, round_even(v * 2, 6) AS vector_ms, round_even(v, 6) AS keyword_ms, NULL::DOUBLE AS merge_ms, NULL::DOUBLE AS rerank_ms, NULL::DOUBLE AS threshold_ms FROM e",
    "trace_hits": _H + "SELECT trace_id, layer, rank, 'c' || c AS chunk_id, CASE WHEN layer = 'final' THEN '' ELSE 'd' || x END AS document_id, CASE WHEN layer = 'final' THEN 'p. 1' ELSE 'a > ' || x END AS section_path, vector_score, keyword_score, rerank_score, combined_score, CASE WHEN layer = 'final' THEN 'text' ELSE '' END AS text_preview FROM hits",
    "trace_layers": _H + "SELECT trace_id, layer, list_position(['vector', 'keyword', 'merged', 'reranked', 'final'], layer) AS place, count(*) AS n, min(rank) AS best_rank FROM hits GROUP BY ALL",
    "trace_calls": _K + "SELECT trace_id, CASE WHEN k % 3 > 0 THEN k % 3 WHEN k % 7 <> 0 THEN 1 ELSE 0 END AS generation, (k % 4 = 0)::INT AS query_rewrite, (k % 2 = 0)::INT AS router, CASE WHEN k % 3 > 0 THEN k % 3 WHEN k % 7 <> 0 THEN 1 ELSE 0 END + (k % 2 = 0)::INT AS total, k % 19 = 0 OR k % 10 = 0 OR (k % 13 = 0 AND k % 11 <> 0) AS insufficient FROM e",
    "trace_first_failures": _K + """, s AS (SELECT CASE WHEN k % 17 = 0 THEN 'GUARDRAIL' WHEN k % 3 <> 1 AND k % 5 = 1 THEN 'ROUTER' WHEN k % 8 = 0 THEN 'QUERY_REWRITE' WHEN k % 5 <> 1 AND k % 4 = 0 THEN 'RETRIEVAL'
      WHEN k % 5 <> 1 AND k % 6 <> 0 AND k % 4 > CASE WHEN k % 3 > 0 THEN k % 3 ELSE k % 4 END AND k % 3 = 0 THEN 'RERANKER' WHEN k % 5 <> 1 AND k % 3 = 0 THEN 'FINAL_CONTEXT' WHEN k % 10 <> 0 AND k % 11 = 0 THEN 'GENERATION' WHEN k % 5 <> 1 AND k % 9 = 0 THEN 'GENERATION'
      WHEN k % 10 = 0 THEN 'GROUNDING' WHEN k % 5 <> 1 AND k % 13 = 0 AND k % 11 <> 0 THEN 'RETRIEVAL' WHEN k % 14 = 0 THEN 'RESPONSE' ELSE 'NONE' END AS step FROM e) SELECT step, count(*) AS n FROM s GROUP BY 1""",
}
