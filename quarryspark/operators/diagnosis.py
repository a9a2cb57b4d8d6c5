"""Diagnosis of retrieval runs: whether all of the expected was found, why a question failed, and reports over layers.

Hits are (query_id, chunk_id, rank, ...), expectations (query_id, chunk_id); every table may be larger than memory, so the
driver sees none of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .corpus import first_that
from .evaluation import CUTS, SEVERITY

WITHIN = (10, 20, 50, 100)


def all_ranks(hits: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_expected, n_found, rank): the rank at which the last of all expected chunks was found, null where
    one was not or nothing is expected."""
    want = expected.select("query_id", "chunk_id").distinct()
    found = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    rows = want.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_expected"), F.count("rank").alias("n_found"), F.max("rank").alias("last"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return queries.select("query_id").join(rows, "query_id", "left").select("query_id", n("n_expected"), n("n_found"), F.when(F.col("n_expected") == F.col("n_found"), F.col("last")).alias("rank"))


def listed(rank: Column, k: int = 10) -> Column:
    """struct(rank, hit, mrr) of one list."""
    return F.struct(rank.alias("rank"), F.coalesce(rank <= k, F.lit(False)).alias("hit"), F.coalesce(F.bround(1 / rank, 4), F.lit(0.0)).alias("mrr"))


def document_analysis(hits: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, best_rank, best_score, in_top_10 ... in_top_100) of the expected documents, by their best chunk.
    hits: (query_id, document_id, rank, score); expected: (query_id, document_id)."""
    own = hits.join(expected.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_semi")
    best = own.groupBy("query_id").agg(F.min("rank").alias("best_rank"), F.min_by("score", "rank").alias("best_score"))
    rows = queries.select("query_id").join(best, "query_id", "left")
    return rows.withColumns({f"in_top_{k}": F.coalesce(F.col("best_rank") <= k, F.lit(False)) for k in WITHIN})


def document_ranks(hits: DataFrame) -> DataFrame:
    """(query_id, document_id, score, rank): documents by their best chunk's score, of equals the smaller id first."""
    best = hits.where("document_id is not null").groupBy("query_id", "document_id").agg(F.max(F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")))


def document_texts(chunks: DataFrame) -> DataFrame:
    """(document_id, text): the contents of a document's chunks in their order, with blank lines between them."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("text"))


def missing_expected(expected: DataFrame, corpus: DataFrame) -> DataFrame:
    """The expectations whose chunk the corpus lacks."""
    return expected.join(corpus.select("chunk_id").distinct(), "chunk_id", "left_anti").select("query_id", "chunk_id").distinct()


def mapping_state(expected: DataFrame, corpus: DataFrame, holds: Column) -> DataFrame:
    """(query_id, n_expected, n_missing, status): corpus_gap where nothing is expected, mapping_issue where an expected
    chunk is missing or none of them holds what is asked (`holds`, over both tables' columns), else resolved."""
    rows = expected.join(corpus, "chunk_id", "left").withColumn("there", F.col("text").isNotNull()).withColumn("good", F.coalesce(holds, F.lit(False)))
    sums = rows.groupBy("query_id").agg(F.count("chunk_id").alias("n_expected"), F.count_if(F.col("chunk_id").isNotNull() & ~F.col("there")).alias("n_missing"), F.max("good").alias("good"))
    status = F.when(F.col("n_expected") == 0, "corpus_gap").when((F.col("n_missing") > 0) | ~F.col("good"), "mapping_issue").otherwise("resolved")
    return sums.select("query_id", "n_expected", "n_missing", status.alias("status"))


#: What marks a hit as something other than knowledge.
REVIEW_MARKS = ("customer reviews", "write a review", "sort by", "be the first")
SHOP_MARKS = ("view full details", "quantity", "sold out", "add to cart")
MARKETING = ("investor", "prospectus", "annual report")


def competitor_class(text: Column, expected: Column, related: tuple[str, ...], section: Column | None = None, marketing: tuple[str, ...] = MARKETING) -> Column:
    """What kind of text outranked the expected one. The words of related knowledge are the caller's."""
    own, n = tx.filled(text), tx.word_count(text, 1)
    low = F.lower(own)
    where = tx.any_of(F.lower(tx.filled(section)), related) if section is not None else F.lit(False)
    return first_that(
        (expected, "CORRECT_KNOWLEDGE"), (F.contains(own, F.lit("![")) | (F.contains(low, F.lit(".png")) & (n < 40)), "IMAGE_OR_ICON"), (F.contains(low, F.lit("you may also like")), "PRODUCT_CROSS_SELL"),
        (tx.any_of(low, REVIEW_MARKS), "UI_NOISE"), (tx.any_of(low, SHOP_MARKS), "NAVIGATION"), ((n < 25) & (F.length(F.trim(own)) < 140), "HEADING_ONLY"), (tx.any_of(low, marketing), "GENERAL_MARKETING"),
        (tx.any_of(low, related) | where, "RELATED_KNOWLEDGE"), (F.lit(True), "UNKNOWN"),
    )


def targeted(chunk_rank: Column, document_rank: Column, found: Column) -> Column:
    """Where a question's expected chunk ended up."""
    near = F.coalesce(document_rank <= 10, F.lit(False))
    far = F.coalesce(document_rank > 20, F.lit(True))
    return (
        F.when(~found, "EXPECTED_CHUNK_NOT_FOUND").when(chunk_rank <= 10, "DOCUMENT_AND_CHUNK_RETRIEVED").when(near, "DOCUMENT_RETRIEVED_CHUNK_MISSED").when(far, "DOCUMENT_NOT_RETRIEVED")
        .otherwise("DOCUMENT_RETRIEVED_CHUNK_MISSED")
    )


def query_overlap(query: Column, text: Column) -> Column:
    """The share of a query's longer words that a text holds; null for a query without one."""
    terms = F.array_distinct(F.filter(F.split(F.replace(F.lower(tx.filled(query)), F.lit("?"), F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: F.length(w) > 3))
    low = F.lower(tx.filled(text))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda w: F.contains(low, w))) / F.size(terms))


def vector_cause(answerable: Column, n_expected: Column, chunk_rank: Column, document_rank: Column, mismatch: Column, rival: Column) -> Column:
    """Why a question fails by ranks of vectors alone; null if it passes. mismatch: its words are in none of the first
    ten hits; rival: one of them is of a document that is not expected."""
    wide = F.when(mismatch, "QUERY_MISMATCH")
    return (
        F.when(~answerable, "CORPUS_GAP").when(chunk_rank <= 10, None).when(n_expected == 0, "EVALUATION_MAPPING").when(document_rank.isNull(), F.coalesce(wide, F.lit("CORPUS_GAP")))
        .when(document_rank <= 10, "EXPECTED_DOCUMENT_WRONG_CHUNK").when(document_rank <= 100, F.when(rival, "RETRIEVAL_COMPETITION").otherwise("EMBEDDING_REPRESENTATION"))
        .otherwise(F.coalesce(wide, F.lit("EMBEDDING_REPRESENTATION")))
    )


def light_cause(status: Column, chunk_rank: Column, chunk_score: Column, document_rank: Column, tenth_score: Column, noted: Column) -> Column:
    """struct(cause, confidence) from ranks and scores of one list."""
    out = lambda cause, confidence: F.struct(F.lit(cause).alias("cause"), F.lit(confidence).alias("confidence"))
    low = lambda k: F.coalesce(chunk_rank > k, F.lit(True))
    close = chunk_rank.between(11, 30) & (chunk_score >= tenth_score - 0.015)
    return first_that(
        (status == "corpus_gap", out("CORPUS_GAP", 0.95)), (status == "mapping_issue", out("EVALUATION_MAPPING", 0.9)), (chunk_rank <= 10, out("UNRESOLVED", 0.9)), ((document_rank <= 10) & low(10), out("CHUNKING", 0.9)),
        (close, out("RETRIEVAL_COMPETITION", 0.85)), (noted & chunk_rank.isNull(), out("QUERY_MISMATCH", 0.7)), ((document_rank <= 20) & low(20), out("CHUNKING", 0.8)),
        (chunk_rank.isNull() & document_rank.isNull(), out("UNRESOLVED", 0.55)), (F.lit(True), out("UNRESOLVED", 0.5)),
    )


def unified_cause(answerable: Column, n_expected: Column, chunk_rank: Column, document_rank: Column, largest_sibling: Column, rival: Column, summary: Column) -> Column:
    """Why a question fails within ten hits, null if it passes: `largest_sibling` is the token count of the largest hit
    among the first ten that is of an expected document but not expected, `rival` whether one of them is of another
    document, `summary` whether only a summary could answer."""
    sibling = F.when(n_expected > 3, "CHUNK_FRAGMENTATION").when(largest_sibling < 40, "CHUNK_GRANULARITY").otherwise("EXPECTED_DOCUMENT_WRONG_CHUNK")
    return (
        F.when(chunk_rank <= 10, None).when(~answerable, "CORPUS_GAP").when(n_expected == 0, "EVALUATION_MAPPING").when(summary & (chunk_rank > 10), "SUMMARY_MISSING").when(document_rank.isNull(), "CORPUS_GAP")
        .when(largest_sibling.isNotNull(), sibling).when(document_rank <= 100, F.when(rival, "RETRIEVAL_COMPETITION").otherwise("EMBEDDING_REPRESENTATION")).otherwise("UNRESOLVED")
    )


#: The failure that each layer answers for.
LAYERS = {
    "guardrail": "GUARDRAIL_FAILURE", "router": "ROUTER_FAILURE", "query_rewrite": "QUERY_REWRITE_FAILURE", "retrieval": "RETRIEVAL_FAILURE", "reranker": "RERANKER_FAILURE", "generation": "GENERATION_FAILURE",
    "grounding": "GROUNDING_FAILURE", "state": "STATE_FAILURE", "lead": "LEAD_WORKFLOW_FAILURE", "support": "SUPPORT_WORKFLOW_FAILURE", "tools": "TOOL_FAILURE", "final_context": "FINAL_CONTEXT_FAILURE",
}


def layer_failures(turns: DataFrame, failure: str = "failure_type") -> DataFrame:
    """(layer, failures) for every layer, 0 where none failed."""
    layer = F.create_map(*[F.lit(x) for layer, name in LAYERS.items() for x in (name, layer)])
    counts = turns.groupBy(F.try_element_at(layer, F.col(failure)).alias("layer")).agg(F.count("*").alias("c")).where("layer is not null")
    every = turns.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    return every.join(counts, "layer", "left").select("layer", F.coalesce("c", F.lit(0)).alias("failures"))


def behaviour(conversations: DataFrame, category: str, retrievals: str, switches: str) -> DataFrame:
    """One row: turns that retrieved, and conversations about leads, about support, and with a change of product."""
    begins = lambda name: F.count_if(F.col(category).startswith(name))
    return conversations.agg(F.sum(retrievals).alias("rag_turns"), begins("LEAD").alias("lead_conversations"), begins("SUPPORT").alias("support_conversations"), F.count_if(F.col(switches) > 0).alias("product_switch_conversations"))


def candidates_by(conversations: DataFrame, category: str, candidate: str) -> DataFrame:
    return conversations.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(candidate), F.lit(False))).alias("candidate_failures"))


def representatives(failures: DataFrame, cluster: list[str], conversation: str, failure: str, product: str, k: int = 5) -> DataFrame:
    """Up to k conversations of each cluster: the three gravest, then the first of each further product, then the rest by
    gravity and id. A conversation counts by its gravest row. `place` gives their order."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col(failure)), F.lit(0))
    rows = failures.groupBy(*cluster, conversation).agg(F.min(F.struct(F.lit(0) - weight, F.col(product))).alias("_g")).select(*cluster, conversation, F.col("_g.col1").alias("gravity"), F.coalesce(F.col(f"_g.{product}"), F.lit("")).alias(product))
    own = Window.partitionBy(*cluster)
    by = [F.asc("gravity"), F.asc(conversation)]
    rows = rows.withColumn("at", F.row_number().over(own.orderBy(*by)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*cluster, product).orderBy("at")))
    turn = F.when(F.col("at") <= 3, 0).when(F.col("nth") == 1, 1).otherwise(2)
    return rows.withColumn("place", F.row_number().over(own.orderBy(turn, "at"))).where(F.col("place") <= k).select(*cluster, conversation, product, "place")


def regression(hits: DataFrame, needles: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_needles, n_found, leaked, passed): whether the first k hits together hold every needle and no
    metadata. hits: (query_id, rank, text); needles: (query_id, needles). Each needle is looked for hit by hit."""
    top = hits.where(F.col("rank") <= k)
    leak = top.groupBy("query_id").agg(F.max((F.col("rank") <= 3) & F.contains(F.lower("text"), F.lit("sha256:"))).alias("leaked"))
    asked = needles.select("query_id", F.explode_outer("needles").alias("needle"))
    held = asked.join(top, "query_id", "left").groupBy("query_id", "needle").agg(F.max(F.contains(F.lower("text"), F.lower("needle"))).alias("held"), F.count("rank").alias("n"))
    sums = held.groupBy("query_id").agg(F.count("needle").alias("n_needles"), F.count_if(F.coalesce("held", F.lit(False))).alias("n_found"), F.max("n").alias("n_hits"))
    rows = sums.join(leak, "query_id", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))
    return rows.select("query_id", "n_needles", "n_found", "leaked", ((F.col("n_found") == F.col("n_needles")) & (F.col("n_hits") > 0) & ~F.col("leaked")).alias("passed"))


def recall_of_all(ranks: DataFrame) -> DataFrame:
    """all_ranks() with recall_at_k and reciprocal rank where every expected chunk is required."""
    return ranks.withColumns({f"recall_at_{k}": F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)) for k in CUTS} | {"reciprocal_rank": F.coalesce(1 / F.col("rank"), F.lit(0.0))})
