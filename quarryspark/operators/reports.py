"""Reports in one pass: counts by several groupings at once, as grouping sets, with sketches that merge; and verdicts by
gates on the result. One shuffle of partial sums, whatever the number of groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The gates of a diagnosis.
FRAGMENTS, MISSING_SUMMARIES, LEAST_PASS_AT_5, LEAST_SUMMARY_PASS, MOST_GAPS, MOST_EMBEDDING = 3, 2, 0.55, 60.0, 4, 0.35
GOOD, WORSE = "GOOD", "NEEDS_IMPROVEMENT"


def by_groupings(rows: DataFrame, groupings: list[tuple[str, ...]], measures: dict[str, Column], sketch_of: str | None = None) -> DataFrame:
    """(grouping, one column for each dimension, n, measures): for each grouping its groups, named by its columns joined by
    a plus sign, `all` for the empty one; columns outside it are null. With sketch_of, `sketch` is a mergeable sketch of
    its distinct values and `n_distinct` the estimate."""
    names = list(dict.fromkeys(c for g in groupings for c in g))
    sums = [F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()]]
    if sketch_of:
        sums.append(F.hll_sketch_agg(sketch_of, F.lit(14)).alias("sketch"))
    marks = [F.grouping(c).alias(f"_g_{c}") for c in names]
    found = rows.groupingSets([[F.col(c) for c in g] for g in groupings], *[F.col(c) for c in names]).agg(*sums, *marks)
    label = F.array_join(F.filter(F.array(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in names]), lambda x: x.isNotNull()), "+")
    out = found.withColumn("grouping", F.when(label == "", "all").otherwise(label)).drop(*[f"_g_{c}" for c in names])
    return out.withColumn("n_distinct", F.hll_sketch_estimate("sketch")) if sketch_of else out


def audit_summary(records: DataFrame) -> DataFrame:
    """by_groupings() of audited documents (document_id, website, source_type, extraction_method, processing_status,
    warnings, boilerplate, retention_bucket, ocr_issues, n_critical, n_warning, n_info): by each of the first four, by
    website and type, and of all."""
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    measures = {
        "n_with_warnings": F.count_if(some("warnings") > 0), "n_boilerplate": F.count_if(some("boilerplate") > 0), "n_high_loss": F.count_if(F.col("retention_bucket") == "high_loss"), "n_moderate_loss": F.count_if(F.col("retention_bucket") == "moderate_loss"),
        "n_ocr_issues": F.count_if(some("ocr_issues") > 0), "n_critical": F.sum(some("n_critical")), "n_warning": F.sum(some("n_warning")), "n_info": F.sum(some("n_info")), "n_to_review": F.count_if(some("n_critical") + some("n_warning") + some("n_info") > 0),
    }
    return by_groupings(records, [("website",), ("source_type",), ("extraction_method",), ("processing_status",), ("website", "source_type"), ()], measures, "document_id")


def diagnosis(questions: DataFrame) -> DataFrame:
    """(category, n, n_answerable, n_gaps, pass_at_5_pct, pass_at_5_rate, pass_at_10_rate, document_at_5_rate,
    document_at_10_rate, n_failed, n_embedding, n_fragments, n_missing_summaries) of questions (category, answerability,
    passed_at_5, passed_at_10, root_cause, document_rank) by category, and of all with a null category. Rates are of
    answerable questions, to four places; the percentage to two."""
    ok = F.coalesce(F.col("answerability") != "CORPUS_GAP", F.lit(True))
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = F.count_if(ok)
    share = lambda c: F.bround(F.when(n > 0, F.count_if(ok & yes(c)) / n).otherwise(0.0), 4)
    cause = lambda *names: F.count_if(ok & yes(F.col("root_cause").isin(*names)))
    return questions.rollup("category").agg(
        F.count("*").alias("n"), n.alias("n_answerable"), F.count_if(~ok).alias("n_gaps"), F.bround(F.when(n > 0, 100.0 * F.count_if(ok & yes(F.col("passed_at_5"))) / n).otherwise(0.0), 2).alias("pass_at_5_pct"),
        share(F.col("passed_at_5")).alias("pass_at_5_rate"), share(F.col("passed_at_10")).alias("pass_at_10_rate"), share(F.col("document_rank") <= 5).alias("document_at_5_rate"), share(F.col("document_rank") <= 10).alias("document_at_10_rate"),
        F.count_if(ok & ~yes(F.col("passed_at_10")) & F.col("root_cause").isNotNull()).alias("n_failed"), F.count_if(yes(F.col("root_cause") == "EMBEDDING_REPRESENTATION")).alias("n_embedding"), cause("CHUNK_FRAGMENTATION", "CHUNK_GRANULARITY").alias("n_fragments"), cause("SUMMARY_MISSING").alias("n_missing_summaries"),
    )


def verdicts(found: DataFrame, summary: str = "SUMMARY") -> DataFrame:
    """One row of verdicts on diagnosis(): chunking, retrieval, summaries, corpus and embedding model. It reads the result,
    a row a category, not the questions."""
    every = lambda c: F.max(F.when(F.col("category").isNull(), F.col(c)))
    good = lambda c: F.when(F.coalesce(c, F.lit(False)), GOOD).otherwise(WORSE)
    failed = every("n_failed")
    return found.agg(
        good((every("n_fragments") < FRAGMENTS) & (every("n_missing_summaries") < MISSING_SUMMARIES)).alias("chunking_quality"), good(every("pass_at_5_rate") >= LEAST_PASS_AT_5).alias("retrieval_quality"),
        good(F.max(F.when(F.col("category") == summary, F.col("pass_at_5_pct"))) >= LEAST_SUMMARY_PASS).alias("summary_representation"), good(every("n_gaps") <= MOST_GAPS).alias("corpus_quality"),
        F.when((failed > 0) & (every("n_embedding") / failed >= MOST_EMBEDDING), "INVESTIGATE").otherwise("DO_NOT_CHANGE").alias("embedding_model"),
    )
