"""Which chunks hold the expected knowledge: facts, needles and anchors, and where fused lists lose it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def fact_matches(fact: Column, combined: Column) -> Column:
    """A fact stands in a text (small letters, single spaces): as a whole, else one of its parts between bars, else
    between slashes, else a token of five or more characters."""
    whole = tx.match_text(fact)
    part = lambda sign: F.exists(F.filter(F.transform(F.split(fact, sign), tx.match_text), lambda p: p != ""), lambda p: F.contains(combined, p))
    long_tokens = F.regexp_extract_all(whole, F.lit("[a-z0-9]{5,}"), F.lit(0))
    return F.contains(combined, whole) | F.when(F.contains(fact, F.lit("|")), part(r"\|")).when(F.contains(fact, F.lit("/")), part("/")).otherwise(F.exists(long_tokens, lambda t: F.contains(combined, t)))


def needles(answer: Column, least: int = 20) -> Column:
    """The sentences of an answer that have at least `least` characters."""
    return F.filter(F.transform(F.split(tx.filled(answer), r"[.!?;\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def best_by_needles(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, n): of each query's candidates (query_id, chunk_id, text), those that hold the most of its
    needles (query_id, needles), one at least. Candidates come from a search, so no text meets every query."""
    found = candidates.join(wanted, "query_id").withColumn("t", tx.match_text(F.col("text")))
    n = F.size(F.filter("needles", lambda x: F.contains(F.col("t"), tx.match_text(x))))
    best = F.max("n").over(Window.partitionBy("query_id"))
    return found.select("query_id", "chunk_id", n.alias("n")).withColumn("best", best).where("n > 0 and n = best").drop("best")


def anchor_matches(haystack: Column, path: Column, anchor: Column) -> Column:
    """Whether a chunk's small-letter text meets an anchor: struct(exclude, section_prefix, all_of, any_of)."""
    low = lambda x: F.lower(x)
    without = ~F.exists(anchor["exclude"], lambda x: F.contains(haystack, low(x)))
    prefix = anchor["section_prefix"].isNull() | F.exists(path, lambda p: F.startswith(F.trim(p), anchor["section_prefix"]))
    every = F.forall(anchor["all_of"], lambda x: F.contains(haystack, low(x)))
    some = (F.size(anchor["any_of"]) == 0) | F.exists(anchor["any_of"], lambda x: F.contains(haystack, low(x)))
    return without & prefix & every & some


def locus(vector_rank: Column, keyword_rank: Column, merged_rank: Column, k: int = 10) -> Column:
    """Where the evidence got lost on its way through two lists and their merge."""
    return (
        F.when(vector_rank.isNotNull() & F.coalesce(merged_rank > k, F.lit(True)), "merge_only").when(vector_rank.isNull() & keyword_rank.isNull(), "absent_from_both_pools")
        .when(vector_rank.isNull(), "keyword_only").otherwise("vector_has_it")
    )


def json_object(text: Column) -> Column:
    """The JSON object of a model's answer as a variant: without thoughts and a code fence, else from the first opening
    brace to the last closing one; null for what is no object."""
    bare = F.trim(F.regexp_replace(tx.filled(text), r"(?is)<think>.*?</think>", ""))
    bare = F.trim(F.regexp_replace(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    value = lambda t: F.when(F.startswith(F.trim(t), F.lit("{")), F.try_parse_json(t))
    return F.coalesce(value(bare), value(inner))


def vector_issues(vector: Column, length: int) -> Column:
    """What is wrong with an embedding: its length, a component that is not finite, a norm that is not 1."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.array_compact(F.array(
        F.when(F.size(vector) != length, "length"), F.when(F.exists(vector, lambda x: x.isNull() | F.isnan(x)), "not_finite"), F.when(F.abs(norm - 1) > 1e-3, "norm"),
    ))
