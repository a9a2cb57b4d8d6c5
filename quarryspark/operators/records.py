"""Records of conversations and runs: contexts merged over turns, sources resolved, maps redacted, reports of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Keys whose values are never shown.
SECRET_KEYS = ("phone", "email", "user_name", "name", "api_key", "authorization", "token", "password", "secret", "openai_api_key", "generation_api_key")


def safe_text(text: Column) -> Column:
    """A text without the null character, which some stores refuse."""
    return F.replace(text, F.lit("\x00"), F.lit(""))


def redacted_map(values: Column) -> Column:
    """A map of strings with the values of secret keys hidden and the other values redacted."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS) & (F.coalesce(v, F.lit("")) != ""), "[redacted]").when(v.isNotNull(), tx.redacted(v)))


def identity_of_phone(raw: Column, country: str = "+91") -> Column:
    """One key for a phone number however it is written: the valid mobile number with its country, else its digits, else
    nothing."""
    digits = F.regexp_replace(tx.filled(raw), "[^0-9]", "")
    return F.coalesce(F.concat(F.lit(country), tx.mobile_number(raw)), F.when(digits != "", F.concat(F.lit("+"), digits)), F.lit(""))


def merged_context(turns: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, fields...): each field's last value that is neither null nor empty. A grouped maximum for each field, partly
    computed before one shuffle."""
    last = lambda c: F.max(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"].alias(c)
    return turns.groupBy(key).agg(*[last(c) for c in fields])


def resolved_sources(returned: Column, allowed: Column) -> Column:
    """The allowed ids that returned ids stand for: equal, or the one that begins like it or with which it begins; each
    once, in order. Where none is resolved, all allowed ids, sorted, stand."""
    known = F.filter(F.array_distinct(allowed), lambda a: F.coalesce(a, F.lit("")) != "")
    like = lambda r: F.filter(known, lambda a: F.startswith(a, r) | F.startswith(r, a))
    one = lambda r: F.when(F.array_contains(known, r), r).when(F.size(like(r)) == 1, F.try_element_at(like(r), F.lit(1)))
    given = F.filter(F.transform(returned, lambda r: F.trim(r)), lambda r: F.coalesce(r, F.lit("")) != "")
    found = F.array_distinct(F.array_compact(F.transform(given, one)))
    return F.when(F.size(found) > 0, found).otherwise(F.array_sort(known))


def chunk_report(chunks: DataFrame, group: str, low: int = 30, high: int = 150) -> DataFrame:
    """(group, n_documents, n_chunks, tokens, mean, least, most, n_small, n_large): sums by group."""
    t = F.col("token_count")
    per = chunks.groupBy(group, "document_id").agg(F.count("*").alias("c"), F.sum(t).alias("s"), F.min(t).alias("a"), F.max(t).alias("b"), F.count_if(t < low).alias("l"), F.count_if(t > high).alias("h"))
    rows = per.groupBy(group).agg(F.count("*").alias("n_documents"), F.sum("c").alias("n_chunks"), F.sum("s").alias("tokens"), F.min("a").alias("least"), F.max("b").alias("most"), F.sum("l").alias("n_small"), F.sum("h").alias("n_large"))
    return rows.withColumn("mean", F.bround(F.col("tokens") / F.col("n_chunks"), 4))


def json_artifacts(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON documents by a schema, with `corrupt` where a document is none: nothing is inferred and nothing dropped."""
    parsed = F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    found = rows.withColumn("_j", parsed)
    return found.select(*[c for c in rows.columns if c != column], "_j.*").withColumn("corrupt", F.col("_corrupt").isNotNull()).drop("_corrupt")
