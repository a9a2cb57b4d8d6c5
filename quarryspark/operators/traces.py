"""Flattening of JSON traces of chat turns: one row a turn, one row a hit of each retrieval layer, calls and failures.

A trace is parsed once by a schema of the fields that are read; the rest of it is passed over. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources import json_files
from .corpus import first_that

_HIT = "struct<chunk_id:string,document_id:string,title:string,section_path:string,section:string,rank:int,position:int,vector_score:double,keyword_score:double,rerank_score:double,combined_score:double,score:double,original_retrieval_rank:int,text_preview:string,text:string>"
_MS = "vector_ms:double,keyword_ms:double,merge_ms:double,rerank_ms:double,threshold_ms:double"
SCHEMA = f"""struct<
  request:struct<conversation_id:string,user_message:string>, query:struct<rewrite_executed:boolean,rewritten_query:string>, turn_understanding:struct<turn_intent:string,needs_rag:boolean,method:string>,
  guardrail:struct<blocked:boolean>, retrieval:struct<backend:string,retrieval_query:string,timings:struct<{_MS}>,vector:array<{_HIT}>,keyword:array<{_HIT}>,merged:array<{_HIT}>,candidates:array<{_HIT}>>,
  reranking:struct<enabled:boolean,name:string,candidates:array<{_HIT}>>, final_context:struct<chunks:array<{_HIT}>>, generation:struct<model:string,llm_call_count:int,raw_output:string,generation_result:string>,
  grounding:struct<validator_result:boolean,validator_reason:string,fallback_triggered:boolean,grounded_returned:boolean>, tool_execution:struct<tool_name:string,success:boolean,lead_id:string,ticket_id:string,latency_ms:double>,
  response:struct<final_response:string>, latency:struct<guardrail_ms:double,routing_ms:double,router_ms:double,rewrite_ms:double,retrieval_ms:double,generation_ms:double,tool_ms:double,total_ms:double,{_MS}>>"""
#: The layers of retrieval in their order, and what a validator says of an answer that is no answer.
LAYERS = ("vector", "keyword", "merged", "reranked", "final")
NO_ANSWER = ("invalid_json", "missing_fields", "invalid_grounded_flag", "invalid_answer")


def parsed(traces: DataFrame, column: str = "trace") -> DataFrame:
    """traces with `t`, the parsed trace; a trace that is no JSON gives nulls."""
    return traces.withColumn("t", F.from_json(column, SCHEMA))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, t, _file) of traces stored as JSON lines. Parts of a trace that a query doesn't name are not parsed; lines
    that are no trace are left out (json_files.accounted() counts them)."""
    inner = spark.range(0).select(F.lit(None).cast(SCHEMA).alias("t")).schema["t"].dataType
    rows = json_files.read(spark, path, StructType([StructField("trace_id", StringType()), *inner.fields])).where(F.col("trace_id").isNotNull())
    return rows.select("trace_id", F.struct(*inner.names).alias("t"), "_file")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _given(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def turn_fields(rows: DataFrame) -> DataFrame:
    """One row for each parsed trace: who asked what, what was answered, by which tool, and how long each step took. A
    step's time stands with the latencies or, for layers of retrieval, with their timings."""
    ms = lambda name, *others: F.coalesce(*[F.col(c) for c in (f"t.latency.{name}", *others)]).alias(name)
    layer = lambda name: ms(name, f"t.retrieval.timings.{name}")
    return rows.select(
        "trace_id", _text("t.request.conversation_id").alias("conversation_id"), _text("t.request.user_message").alias("user_message"), F.coalesce(_given("t.query.rewritten_query"), _given("t.retrieval.retrieval_query")).alias("rewritten_query"),
        _text("t.turn_understanding.turn_intent").alias("intent"), _text("t.response.final_response").alias("response"), _given("t.tool_execution.tool_name").alias("tool_name"), F.col("t.tool_execution.success").alias("tool_success"),
        _given("t.tool_execution.lead_id").alias("lead_id"), _given("t.tool_execution.ticket_id").alias("ticket_id"), F.col("t.retrieval.backend").alias("backend"), F.col("t.reranking.name").alias("reranker_name"),
        ms("guardrail_ms"), ms("routing_ms", "t.latency.router_ms"), ms("rewrite_ms"), ms("retrieval_ms"), ms("generation_ms"), ms("tool_ms", "t.tool_execution.latency_ms"), ms("total_ms"),
        *map(layer, ("vector_ms", "keyword_ms", "merge_ms", "rerank_ms", "threshold_ms")),
    )


def _section(hit: Column) -> Column:
    """A path that is a list is read as its JSON, and joined; another value stands as it is."""
    value = F.coalesce(hit["section_path"], hit["section"])
    return F.coalesce(F.when(value.startswith("["), F.array_join(F.from_json(value, "array<string>"), " > ")).otherwise(value), F.lit(""))


def layer_hits(rows: DataFrame) -> DataFrame:
    """(trace_id, layer, rank, chunk_id, document_id, title, section_path, scores, text_preview) of every hit of every
    layer. In the final layer a hit's position is its rank."""
    arrays = {"vector": "t.retrieval.vector", "keyword": "t.retrieval.keyword", "merged": "t.retrieval.merged", "reranked": "t.reranking.candidates", "final": "t.final_context.chunks"}
    none = F.array().cast(f"array<struct<layer:string,h:{_HIT}>>")

    def tagged(name: str, hits: str) -> Column:
        return F.coalesce(F.transform(F.col(hits), lambda h: F.struct(F.lit(name).alias("layer"), h.alias("h"))), none)

    every = [tagged(name, hits) for name, hits in arrays.items()]
    hits = rows.select("trace_id", F.explode(F.concat(*every)).alias("x")).select("trace_id", "x.layer", "x.h")
    h, zero = F.col("h"), F.lit(0)
    rank = F.coalesce(F.nullif(h["rank"], zero), h["position"], zero)
    return hits.select(
        "trace_id", "layer", F.when((F.col("layer") == "final") & h["position"].isNotNull(), F.coalesce(F.nullif(h["position"], zero), rank)).otherwise(rank).alias("rank"),
        *[F.coalesce(h[c], F.lit("")).alias(c) for c in ("chunk_id", "document_id", "title")], _section(h).alias("section_path"), h["vector_score"].alias("vector_score"), h["keyword_score"].alias("keyword_score"),
        F.coalesce(h["rerank_score"], h["score"]).alias("rerank_score"), F.coalesce(h["combined_score"], h["score"]).alias("combined_score"), h["original_retrieval_rank"].alias("original_retrieval_rank"),
        F.coalesce(F.nullif(h["text_preview"], F.lit("")), h["text"], F.lit("")).alias("text_preview"),
    )


def by_layer(hits: DataFrame) -> DataFrame:
    """(trace_id, layer, place, n, best_rank): the layers of a trace in their order, unknown ones behind."""
    place = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer"))
    found = hits.groupBy("trace_id", "layer").agg(F.count("*").alias("n"), F.min("rank").alias("best_rank"))
    return found.select("trace_id", "layer", F.when(place > 0, place).otherwise(len(LAYERS) + 1).cast("int").alias("place"), "n", "best_rank")


def llm_calls(t: Column) -> Column:
    """struct(generation, query_rewrite, router, total): calls of language models in a turn. A rewrite is part of the
    router's work, so the total leaves it out."""
    made = F.coalesce(F.nullif(t["generation"]["llm_call_count"], F.lit(0)), F.when(F.coalesce(t["generation"]["model"], F.lit("")) != "", 1).otherwise(0))
    rewrite = F.coalesce(t["query"]["rewrite_executed"].cast("int"), F.lit(0))
    router = F.coalesce((t["turn_understanding"]["method"] == "llm").cast("int"), F.lit(0))
    return F.struct(made.alias("generation"), rewrite.alias("query_rewrite"), router.alias("router"), (made + router).alias("total"))


def insufficient(t: Column, message: str) -> Column:
    """Whether an answer says that nothing is known, fell back without ground, or had none to stand on."""
    g = t["grounding"]
    return (
        F.contains(F.lower(F.coalesce(t["response"]["final_response"], F.lit(""))), F.lit(message.lower()))
        | (F.coalesce(g["fallback_triggered"], F.lit(False)) & ~F.coalesce(g["grounded_returned"], F.lit(False)))
        | F.coalesce(g["validator_reason"].isin("llm_ungrounded", "empty_hits"), F.lit(False))
    )


def _ids(hits: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(hits, lambda h: h["chunk_id"]), lambda c: F.coalesce(c, F.lit("")) != ""), none)


def first_failure(t: Column) -> Column:
    """The first step of a turn that failed, or NONE."""
    rag = F.coalesce(t["turn_understanding"]["needs_rag"], F.lit(False))
    raw, final = _ids(t["retrieval"]["candidates"]), _ids(t["final_context"]["chunks"])
    enabled = F.coalesce(t["reranking"]["enabled"], F.lit(False))
    again = F.when(enabled, _ids(t["reranking"]["candidates"])).otherwise(F.array().cast("array<string>"))
    reason = F.coalesce(t["grounding"]["validator_reason"], F.lit(""))
    kept = F.slice(again, 1, F.greatest(F.lit(1), F.when(F.size(final) > 0, F.size(final)).otherwise(F.size(again))))
    top = F.try_element_at(raw, F.lit(1))
    spoken = F.coalesce(F.nullif(t["generation"]["raw_output"], F.lit("")), F.nullif(t["generation"]["generation_result"], F.lit(""))).isNotNull()
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return first_that(
        (t["guardrail"]["blocked"], "GUARDRAIL"), ((t["turn_understanding"]["turn_intent"] == "KNOWLEDGE") & ~t["turn_understanding"]["needs_rag"], "ROUTER"),
        (t["query"]["rewrite_executed"] & blank(t["query"]["rewritten_query"]), "QUERY_REWRITE"), (rag & (F.size(raw) == 0), "RETRIEVAL"),
        (rag & (F.size(again) > 0) & ~F.array_contains(kept, top) & ~F.array_contains(final, top), "RERANKER"), (rag & (F.size(final) == 0), "FINAL_CONTEXT"), (reason.isin(*NO_ANSWER), "GENERATION"),
        (rag & ~spoken, "GENERATION"), (~t["grounding"]["validator_result"] & ~reason.isin("", "empty_hits"), "GROUNDING"), (rag & (reason == "empty_hits"), "RETRIEVAL"), (blank(t["response"]["final_response"]), "RESPONSE"), (F.lit(True), "NONE"),
    )
