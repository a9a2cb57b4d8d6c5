"""Evaluation of ranked hits: recall, reciprocal rank, comparisons, percentiles, failure clusters and root causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def first_ranks(hits: DataFrame, expected: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, rank): the first hit that is expected, null if none is. expected: (query_id, chunk_id)."""
    found = hits.join(expected.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    return queries.select("query_id").join(found.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def measured(ranks: DataFrame) -> DataFrame:
    """Adds recall_at_k, reciprocal_rank and passed (within 10) to a table with `rank`."""
    at = {f"recall_at_{k}": F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)) for k in CUTS}
    return ranks.withColumns(at | {"reciprocal_rank": F.coalesce(1 / F.col("rank"), F.lit(0.0)), "passed": F.coalesce(F.col("rank") <= 10, F.lit(False))})


def summary(results: DataFrame, *by: str) -> DataFrame:
    """Means to four places, and counts."""
    means = [F.bround(F.avg(f"recall_at_{k}"), 4).alias(f"recall_at_{k}") for k in CUTS]
    return results.groupBy(*by).agg(*means, F.bround(F.avg("reciprocal_rank"), 4).alias("mrr"), F.count("*").alias("total"), F.count_if("passed").alias("passed"))


def compared(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(query_id, baseline_rank, candidate_rank, rank_delta, change) of two versions' first ranks."""
    b, c = baseline.select("query_id", F.col("rank").alias("baseline_rank")), candidate.select("query_id", F.col("rank").alias("candidate_rank"))
    was, now = F.coalesce(F.col("baseline_rank") <= 10, F.lit(False)), F.coalesce(F.col("candidate_rank") <= 10, F.lit(False))
    change = F.when(~was & now, "newly_passed").when(was & ~now, "newly_failed").otherwise("unchanged")
    return b.join(c, "query_id").select("query_id", "baseline_rank", "candidate_rank", (F.col("baseline_rank") - F.col("candidate_rank")).alias("rank_delta"), change.alias("change"))


def rank_change(raw: DataFrame, reranked: DataFrame) -> DataFrame:
    """(query_id, raw_rank, reranked_rank, rank_delta, status) of first ranks before and behind a reranker."""
    r, s = raw.select("query_id", F.col("rank").alias("raw_rank")), reranked.select("query_id", F.col("rank").alias("reranked_rank"))
    a, b = F.col("raw_rank"), F.col("reranked_rank")
    status = F.when(a.isNotNull() & b.isNull(), "regressed").when(b < a, "improved").when(b > a, "regressed").otherwise("unchanged")
    return r.join(s, "query_id").select("query_id", "raw_rank", "reranked_rank", (a - b).alias("rank_delta"), status.alias("status"))


def rank_details(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, n_found, best_rank, best_score, in_top_10, in_top_20) over the expected hits."""
    found = hits.join(expected.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    within = [F.count_if(F.col("rank") <= k).alias(f"in_top_{k}") for k in (10, 20)]
    return found.groupBy("query_id").agg(F.count("*").alias("n_found"), F.min("rank").alias("best_rank"), F.min_by("score", "rank").alias("best_score"), *within)


def competing(hits: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """The first k hits of each query that are not expected, ranked anew."""
    other = hits.join(expected.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    return other.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= k)


def zero_filled(rows: DataFrame, label: str, labels: tuple[str, ...]) -> DataFrame:
    """(label, n) for each of the labels, 0 where none is."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("c"))
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return every.join(counts, "label", "left").select("label", F.coalesce("c", F.lit(0)).alias("n"))


#: The labels of the root-cause report.
ROOT_CAUSES = (
    "CORPUS_GAP", "EXPECTED_DOCUMENT_WRONG_CHUNK", "RETRIEVAL_COMPETITION", "QUERY_MISMATCH", "EMBEDDING_REPRESENTATION", "RETRIEVAL_CONFIGURATION", "EVALUATION_MAPPING",
    "CHUNK_GRANULARITY", "CHUNK_FRAGMENTATION", "SUMMARY_MISSING", "UNRESOLVED",
)


def root_cause(n_expected: Column, chunk_rank: Column, document_rank: Column) -> Column:
    """Why a question fails within ten hits; null if it passes. Ranks are null where nothing was found."""
    return (
        F.when(chunk_rank <= 10, None).when(n_expected == 0, "EVALUATION_MAPPING").when(document_rank.isNull(), "CORPUS_GAP")
        .when(document_rank <= 10, F.when(n_expected > 3, "CHUNK_FRAGMENTATION").otherwise("EXPECTED_DOCUMENT_WRONG_CHUNK"))
        .when(document_rank <= 100, "RETRIEVAL_COMPETITION").otherwise("UNRESOLVED")
    )


def nearest_rank(rows: DataFrame, value: str, percents: tuple[int, ...], *by: str, small: int = 100_000) -> DataFrame:
    """(by..., n, pNN...): the value at place round(p (n - 1)) from 0, halves to even, not interpolated, to three places.

    Exact, in three passes of partial sums: a sketch gives for each place two values between which it lies (in groups of
    at most `small` rows, the smallest and largest), the rows below are counted, and only the distinct values between
    them, some thousandths of a large group, are ranked by their running counts."""
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"))
    least, most = ([min(1.0, max(0.0, p / 100 + d)) for p in percents] for d in (-2e-4, 2e-4))
    sketch = own.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", least, 10_000).alias("lo"), F.percentile_approx("v", most, 10_000).alias("hi"), F.min("v").alias("min"), F.max("v").alias("max"))
    whole = F.col("n") <= small
    edges = [F.struct(F.lit(p).alias("p"), F.when(whole, F.col("min")).otherwise(F.col("lo")[i]).alias("a"), F.when(whole, F.col("max")).otherwise(F.col("hi")[i]).alias("b")) for i, p in enumerate(percents)]
    sketch = sketch.select(*[F.col(c).alias(f"_{c}") for c in by], "n", F.array(*edges).alias("edges"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = own.join(sketch, same).select(*by, "n", "v", F.explode("edges").alias("e")).where(F.col("v") <= F.col("e.b"))
    inside = F.when(F.col("v") >= F.col("e.a"), F.col("v"))
    counts = marked.groupBy(*by, "n", F.col("e.p").alias("p"), inside.alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "p").orderBy(F.col("v").asc_nulls_first()))  # a null stands for all rows below
    place = F.bround(F.col("p") / 100.0 * (F.col("n") - 1), 0).cast("long")
    found = counts.withColumn("upto", upto).where((F.col("upto") > place) & F.col("v").isNotNull())
    return found.groupBy(*by).agg(F.max("n").alias("n"), *[F.bround(F.min(F.when(F.col("p") == p, F.col("v"))), 3).alias(f"p{p}") for p in percents])


#: How grave a failure is; what is not listed weighs 20.
SEVERITY = {
    "GUARDRAIL_FAILURE": 90, "TOOL_FAILURE": 85, "LEAD_WORKFLOW_FAILURE": 80, "SUPPORT_WORKFLOW_FAILURE": 80, "STATE_FAILURE": 75, "GROUNDING_FAILURE": 70, "RERANKER_FAILURE": 65,
    "RETRIEVAL_FAILURE": 60, "FINAL_CONTEXT_FAILURE": 58, "GENERATION_FAILURE": 55, "QUERY_REWRITE_FAILURE": 50, "ROUTER_FAILURE": 48, "CONVERSATION_QUALITY_FAILURE": 40,
    "EXPECTED_BEHAVIOR_MISMATCH": 35, "CORPUS_GAP": 10, "NONE": 0,
}


def most_frequent(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys..., column): its most frequent value in each group, of equals the smallest."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct((-F.col("c")).alias("a"), F.col(column).alias("b"))).alias(column))


def failure_clusters(failures: DataFrame, total: int | Column) -> DataFrame:
    """Clusters of (failure_type, pattern, conversation_id, product): conversations, turns, share in percent, the most
    frequent product, severity. The rows are partly summed before each shuffle."""
    keys = ["failure_type", "pattern"]
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("failure_type")), F.lit(20))
    base = failures.groupBy(*keys).agg(F.count_distinct("conversation_id").alias("n_conversations"), F.count("*").alias("n_turns"))
    found = base.join(most_frequent(failures, keys, "product").withColumnRenamed("product", "common_product"), keys, "left")
    total = total if isinstance(total, Column) else F.lit(total)
    return found.select(F.concat_ws("::", *keys).alias("cluster_id"), *keys, "n_conversations", "n_turns", F.bround(100.0 * F.col("n_conversations") / F.nullif(total, F.lit(0)), 2).alias("percentage"), "common_product", weight.alias("severity"))
