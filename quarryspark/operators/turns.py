"""Turns and conversations of an evaluation run, judged by verified ground truth: each turn's first failing layer and the
pattern of the failure, in one ordered rule, joined with a catalogue of what the corpus knows.

A turn is a row (conversation_id, turn, category, bucket, text, named, keys, error, trace): `named` the product that the
message names, `keys` the knowledge it asks for, `trace` a struct of TRACE. The catalogue is a table (knowledge_key,
answerable, sections, patterns, excludes), the last three arrays of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .evaluation import CUTS

ROW = "struct<chunk_id:string,title:string,section:string,text:string,knowledge_key:string>"
TRACE = (
    "struct<blocked:boolean,final_mode:string,response:string,product_before:string,product_after:string,searched:boolean,rewrite_executed:boolean,rewritten_query:string,"
    f"raw:array<{ROW}>,raw_count:int,rerank_enabled:boolean,reranked:array<{ROW}>,final:array<{ROW}>,validator_reason:string,grounded_returned:boolean,validator_result:boolean,"
    "fallback_triggered:boolean,invalid_source_ids:array<string>,tool_name:string,tool_executed:boolean,tool_success:boolean>"
)
#: What points back at a product, asks for one of its attributes, asks for all products, and compares.
PRONOUN = r"(?i)\b(it|its|this|that|the product)\b"
ATTRIBUTE = r"(?i)\b(price|mrp|cost|warranty|battery|features?|specs?|channels?|how much)\b"
ALL_PRODUCTS = r"(?i)\b(all|every|each)\s+products?\b|\bproducts?\s+(that\s+)?(you|u)\s+have\b|\bthat\s+(you|u)\s+have\b|\b(catalog|pricelist|price\s*list)\b|\bavailable\s+products?\b"
COMPARISON = r"(?i)\bdifference\b|\bcompare\b|\bvs\.?\b"
#: Reasons of the validator, by the layer that they blame.
MALFORMED = ("invalid_json", "missing_fields", "invalid_grounded_flag", "invalid_answer", "invalid_source_ids")
UNSOURCED = ("source_id_not_found", "empty_source_ids")
UNGROUNDED = ("llm_ungrounded", "empty_hits")
CATALOGUE, RULE = "verified_knowledge_key", "deterministic_rule"


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _rows(c: Column) -> Column:
    return F.coalesce(c, F.array().cast(f"array<{ROW}>"))


def row_matches(row: Column, key: Column, sections: Column, patterns: Column, excludes: Column) -> Column:
    """Whether a retrieved row holds an item of the catalogue: by its key, else by what its text must and must not hold; an
    item without any condition is looked for by its key."""
    hay = F.lower(F.concat_ws(" ", *[F.coalesce(row[c], F.lit("")) for c in ("chunk_id", "title", "section", "text", "knowledge_key")]))
    holds = lambda x: F.contains(hay, F.lower(x))
    some = lambda a: (F.size(a) == 0) | F.exists(a, holds)
    stated = F.when((F.size(sections) > 0) | (F.size(patterns) > 0), some(sections) & some(patterns)).otherwise(holds(key))
    by_key = (F.coalesce(row["knowledge_key"], F.lit("")) == key) | ((key != "") & F.contains(F.coalesce(row["chunk_id"], F.lit("")), key))
    return by_key | (~F.exists(excludes, holds) & stated)


def evidence(turns: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(conversation_id, turn, n_answerable, n_gaps, known_keys, raw_ranks, raw_rank, reranked_rank, final_rank) of turns
    that ask for something the catalogue has: where the answerable items stand in the three lists, from 1, null where they
    don't. Keys meet the catalogue by an equal join."""
    asked = turns.select("conversation_id", "turn", F.explode(F.array_distinct("keys")).alias("knowledge_key"), *[_rows(F.col("trace")[c]).alias(c) for c in ("raw", "reranked", "final")])
    held = asked.join(catalogue, "knowledge_key")

    def places(rows: str) -> Column:
        hit = lambda r, i: F.when(row_matches(r, F.col("knowledge_key"), F.col("sections"), F.col("patterns"), F.col("excludes")), i + 1)
        return F.when(F.col("answerable"), F.filter(F.transform(rows, hit), lambda x: x.isNotNull())).otherwise(F.array().cast("array<int>"))

    found = held.select("conversation_id", "turn", "knowledge_key", "answerable", places("raw").alias("raw_places"), *[F.array_min(places(c)).alias(f"{c}_rank") for c in ("reranked", "final")])
    per = found.groupBy("conversation_id", "turn").agg(
        F.count_if("answerable").alias("n_answerable"), F.count_if(~F.col("answerable")).alias("n_gaps"), F.array_sort(F.collect_set("knowledge_key")).alias("known_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("raw_places")))).alias("raw_ranks"), F.min("reranked_rank").alias("reranked_rank"), F.min("final_rank").alias("final_rank"),
    )
    return per.withColumn("raw_rank", F.array_min("raw_ranks"))


def rewrite_required(message: Column, product: Column, named: Column, company: str = r"(?i)\bcompany\b") -> Column:
    """Whether a message leans on the product of the conversation: it points at it without its name, or asks for an
    attribute and names neither a company nor another product."""
    absent = ~F.contains(F.lower(message), F.lower(product))
    bound = message.rlike(ATTRIBUTE) & ~message.rlike(company) & (named.isNull() | (F.lower(named) == F.lower(product)))
    return _yes((product != "") & absent & ~message.rlike(ALL_PRODUCTS) & (message.rlike(PRONOUN) | bound))


def classify_turns(turns: DataFrame, catalogue: DataFrame, insufficient: str) -> DataFrame:
    """(conversation_id, turn, category, failure_type, first_failing_layer, passed, pattern, source, product, known_keys,
    details) of every turn. The first rule that holds decides. A tool runs twice if any earlier turn of the conversation
    named it; a turn without a trace is one that did nothing."""
    t, text, named = F.col("trace"), tx.filled(F.col("text")), F.nullif(F.col("named"), F.lit(""))
    blocked = _yes(t["blocked"]) | _yes(t["final_mode"] == "REJECTED")
    n_raw, n_final = F.size(_rows(t["raw"])), F.size(_rows(t["final"]))
    retrieved = (n_raw > 0) | (n_final > 0) | _yes(t["raw_count"] > 0)
    before, after = F.nullif(t["product_before"], F.lit("")), F.nullif(t["product_after"], F.lit(""))
    rewritten = F.coalesce(t["rewritten_query"], F.lit(""))
    unbound = rewrite_required(text, before, named) & (_yes(t["searched"]) | retrieved) & (~_yes(t["rewrite_executed"]) | ~F.contains(F.lower(rewritten), F.lower(before)))
    reason = F.coalesce(t["validator_reason"], F.lit(""))
    unused = F.contains(F.lower(F.coalesce(t["response"], F.lit(""))), F.lit(insufficient.lower())) | (_yes(t["fallback_triggered"]) & ~_yes(t["grounded_returned"])) | reason.isin(*UNGROUNDED)
    grounded = _yes(t["grounded_returned"]) & _yes(t["validator_result"]) & ~_yes(t["fallback_triggered"])
    answerable, lost = F.col("n_answerable") > 0, F.col("final_rank").isNull()
    dropped = F.col("reranked_rank").isNull() | (F.col("reranked_rank") > F.greatest(F.col("raw_rank"), F.lit(5)))
    plain = lambda c: F.coalesce(F.lower(F.array_join(tx.words(c), " ")), F.lit(""))
    ran, tool = _yes(t["tool_executed"]), F.coalesce(t["tool_name"], F.lit(""))

    def verdict(kind: str, layer: str | None, pattern: str, source: str | None, **details: Column) -> Column:
        pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
        told = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        return F.struct(F.lit(kind).alias("failure_type"), F.lit(layer).cast("string").alias("first_failing_layer"), F.lit(pattern).alias("pattern"), F.lit(source).cast("string").alias("source"), told.alias("details"))

    rules = [
        (F.col("error").isNotNull() & (F.col("error") != ""), verdict("TOOL_FAILURE", "tools", "TURN_ERROR", RULE, error=F.col("error"))),
        (F.col("rule").isNotNull() & blocked, verdict("NONE", None, "GUARDRAIL_BLOCKED", RULE)),
        (F.col("rule").isNotNull(), verdict("GUARDRAIL_FAILURE", "guardrail", "GUARDRAIL_MISSED_INJECTION", RULE, rule=F.col("rule"))),
        (blocked, verdict("GUARDRAIL_FAILURE", "guardrail", "GUARDRAIL_FALSE_POSITIVE", RULE)),
        (unbound, verdict("QUERY_REWRITE_FAILURE", "query_rewrite", "PRODUCT_NOT_BOUND", RULE, rewritten_query=rewritten, product=before)),
        (answerable & ~retrieved, verdict("RETRIEVAL_FAILURE", "retrieval", "EMPTY_RETRIEVAL", CATALOGUE)),
        (answerable & F.col("raw_rank").isNull(), verdict("RETRIEVAL_FAILURE", "retrieval", "EXPECTED_NOT_IN_RAW", CATALOGUE, raw_count=n_raw)),
        (answerable & lost & _yes(t["rerank_enabled"]) & dropped, verdict("RERANKER_FAILURE", "reranker", "RERANKER_DROPPED_EVIDENCE", CATALOGUE, raw_rank=F.col("raw_rank"), reranked_rank=F.col("reranked_rank"))),
        (answerable & lost, verdict("FINAL_CONTEXT_FAILURE", "final_context", "EVIDENCE_NOT_IN_FINAL_CONTEXT", CATALOGUE)),
        (answerable & reason.isin(*MALFORMED), verdict("GENERATION_FAILURE", "generation", "MALFORMED_GENERATION", RULE, validator_reason=reason)),
        (answerable & reason.isin(*UNSOURCED), verdict("GROUNDING_FAILURE", "grounding", "INVALID_SOURCE_IDS", RULE, validator_reason=reason)),
        (answerable & unused, verdict("GENERATION_FAILURE", "generation", "GROUNDED_CONTEXT_UNUSED", CATALOGUE)),
        (answerable & _yes(F.size(t["invalid_source_ids"]) > 0), verdict("GROUNDING_FAILURE", "grounding", "SOURCE_ID_NOT_IN_CONTEXT", RULE)),
        ((F.col("n_gaps") > 0) & retrieved & ~unused & grounded, verdict("GROUNDING_FAILURE", "grounding", "CORPUS_GAP_HALLUCINATION", CATALOGUE, grounded=t["grounded_returned"])),
        (F.col("n_gaps") > 0, verdict("CORPUS_GAP", None, "CORPUS_GAP_OBSERVED", CATALOGUE)),
        (named.isNotNull() & ~text.rlike(COMPARISON) & (plain(after) != plain(named)), verdict("STATE_FAILURE", "state", "STATE_FAILURE_PRODUCT_SWITCH", RULE, **{"from": before, "to": named, "observed": after})),
        (ran & ~F.coalesce(t["tool_success"], F.lit(True)), verdict("TOOL_FAILURE", "tools", "TOOL_EXECUTION_FAILED", RULE, tool_name=tool)),
        (ran & (tool != "") & F.col("tool_before"), verdict("TOOL_FAILURE", "tools", "DUPLICATE_TOOL_EXECUTION", RULE, tool_name=tool)),
    ]
    decided = F.lit(None)
    for holds, then in reversed(rules):
        decided = F.when(_yes(holds), then).otherwise(decided if holds is not rules[-1][0] else verdict("NONE", None, "OBSERVED", None))
    earlier = Window.partitionBy("conversation_id", tool).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    seen = turns.withColumn("tool_before", F.count("*").over(earlier) > 0).withColumn("rule", tx.guardrail(text))
    judged = seen.join(evidence(turns, catalogue), ["conversation_id", "turn"], "left").withColumn("verdict", decided)
    kind = F.col("verdict.failure_type")
    return judged.select(
        "conversation_id", "turn", "category", "verdict.failure_type", "verdict.first_failing_layer", kind.isin("NONE", "CORPUS_GAP").alias("passed"), "verdict.pattern", "verdict.source",
        F.coalesce(named, after).alias("product"), F.coalesce("known_keys", F.array().cast("array<string>")).alias("known_keys"), "verdict.details",
    )


def classify_conversations(classified: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conversation_id, category, turn, failure_type, first_failing_layer, passed, pattern, product, known_keys) of every
    conversation (conversation_id, category): its first turn that failed, else its last turn as one that passed; a
    conversation without turns passes at turn 0. One pass of aggregates, no row of all turns."""
    own = F.struct("turn", "failure_type", "first_failing_layer", "passed", "pattern", "product", "known_keys")
    passed = F.struct("turn", F.lit("NONE").alias("failure_type"), F.lit(None).cast("string").alias("first_failing_layer"), F.lit(True).alias("passed"), F.lit("OBSERVED").alias("pattern"), "product", "known_keys")
    per = classified.groupBy("conversation_id").agg(F.min_by(F.when(~F.col("passed"), own), F.when(~F.col("passed"), F.col("turn"))).alias("failed"), F.max_by(passed, "turn").alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("turn"), F.lit("NONE").alias("failure_type"), F.lit(None).cast("string").alias("first_failing_layer"), F.lit(True).alias("passed"), F.lit("OBSERVED").alias("pattern"), F.lit(None).cast("string").alias("product"), F.array().cast("array<string>").alias("known_keys"))
    return conversations.join(per, "conversation_id", "left").select("conversation_id", "category", F.coalesce("failed", "last", none).alias("v")).select("conversation_id", "category", "v.*")


def retrieval_metrics(turns: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(conversation_id, turn, bucket, recall_at_k, mrr, passed) of turns that ask for something answerable and retrieved
    something: whether a row that holds an item is among the first k, rows without an id not counted."""
    ids = F.filter(F.transform(_rows(F.col("trace")["raw"]), lambda r: r["chunk_id"]), lambda c: F.coalesce(c, F.lit("")) != "")
    found = turns.withColumn("ids", ids).join(evidence(turns, catalogue).where("n_answerable > 0"), ["conversation_id", "turn"]).where(F.size(_rows(F.col("trace")["raw"])) > 0)
    wanted = F.transform(F.filter("raw_ranks", lambda r: r <= F.size("ids")), lambda r: F.element_at("ids", r))
    rank = F.array_min(F.filter(F.transform("ids", lambda c, i: F.when(F.array_contains("wanted", c), i + 1)), lambda x: x.isNotNull()))
    found = found.withColumn("wanted", wanted).withColumn("rank", rank)
    return found.select(
        "conversation_id", "turn", F.coalesce(F.nullif("bucket", F.lit("")), F.lit("Product")).alias("bucket"), *[_yes(F.col("rank") <= k).cast("double").alias(f"recall_at_{k}") for k in CUTS],
        F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("mrr"), _yes(F.col("rank") <= 10).alias("passed"),
    )


def aggregate_retrieval(metrics: DataFrame) -> DataFrame:
    """(bucket, total, passed, recall_at_k, mrr): means to four places by bucket, and of all turns with a null bucket; one
    shuffle, as grouping sets."""
    mean = lambda c: F.bround(F.avg(c), 4).alias(c)
    return metrics.withColumnRenamed("passed", "ok").rollup("bucket").agg(F.count("*").alias("total"), F.count_if("ok").alias("passed"), *[mean(f"recall_at_{k}") for k in CUTS], mean("mrr"))
