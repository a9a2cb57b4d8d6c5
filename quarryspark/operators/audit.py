"""Audits: distributions, bands, cross-tabs, identity collisions, gaps in numbering, pattern hits, sticky values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bands(rows: DataFrame, value: str, low: int = 30, high: int = 150) -> DataFrame:
    """One row: how many values lie under, in and over the band, their mean to two places, median and maximum."""
    v = F.col(value)
    return rows.agg(F.count_if(v < low).alias("under"), F.count_if((v >= low) & (v <= high)).alias("within"), F.count_if(v > high).alias("over"), F.bround(F.avg(v), 2).alias("mean"), F.median(v).alias("median"), F.max(v).alias("most"))


def cross_tab(rows: DataFrame, a: str, b: str, count: str = "n") -> DataFrame:
    """(a, b, n) with all totals; `all` stands for a total, empty for null."""
    named = rows.select(F.coalesce(a, F.lit("")).alias(a), F.coalesce(b, F.lit("")).alias(b))
    cube = named.cube(a, b).agg(F.count("*").alias(count), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return cube.select(F.when(F.col("_ga") == 1, "all").otherwise(F.col(a)).alias(a), F.when(F.col("_gb") == 1, "all").otherwise(F.col(b)).alias(b), count)


def identity_issues(rows: DataFrame, item: str, identity: str, url: str) -> DataFrame:
    """(issue, key, n): identities of several items, and identities that several URLs normalise to."""
    several = rows.groupBy(F.col(identity).alias("key")).agg(F.count("*").alias("n"), F.count_distinct(url).alias("urls"))
    found = several.select("key", "n", F.explode(F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate_identity"), F.when(F.col("urls") > 1, "normalisation_collision")))).alias("issue"))
    return found.select("issue", "key", "n")


def numbering_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, missing, repeated) of the keys whose numbers do not run from 0 without gaps and repeats. Numbers are counted
    by value first, so no key is gathered."""
    each = rows.groupBy(key, number).agg(F.count("*").alias("_n"))
    own = each.groupBy(key).agg(F.sum("_n").alias("_n"), F.count("*").alias("_d"), F.max(number).alias("_m"), F.count_if(F.col(number) >= 0).alias("_k"))
    return own.select(key, (F.col("_m") + 1 - F.col("_k")).cast("int").alias("missing"), (F.col("_n") - F.col("_d")).alias("repeated")).where("missing > 0 or repeated > 0")


def pattern_hits(documents: DataFrame, patterns: dict[str, str], text: str = "text", item: str = "doc_id") -> DataFrame:
    """(item, pattern, n, first): the named patterns that a text has, how often and where first, from 1. The patterns
    are columns of one pass, not a join."""
    hits = F.array(*[F.struct(F.lit(name).alias("pattern"), F.regexp_count(text, F.lit(p)).alias("n"), F.regexp_instr(text, F.lit(p)).alias("first")) for name, p in patterns.items()])
    return documents.select(item, F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("h")).select(item, "h.pattern", "h.n", "h.first")


def sticky(rows: DataFrame, key: str, order: str, value: Column, default: str) -> DataFrame:
    """Adds `sticky`: the last value that is not null up to the row, the default before the first."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("sticky", F.coalesce(F.last(value, ignorenulls=True).over(upto), F.lit(default)))
