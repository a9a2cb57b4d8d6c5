"""Fusion of a vector and a keyword hit list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .retrieval import capped, merged, ranked

def _query() -> WindowSpec:
    return Window.partitionBy("query_id")


def reciprocal_rank(vector: DataFrame, keyword: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """The sum of 1 / (c + rank) over both lists."""
    both = vector.select("query_id", "chunk_id", "rank").union(keyword.select("query_id", "chunk_id", "rank"))
    scores = both.groupBy("query_id", "chunk_id").agg(F.bround(F.sum(1 / (F.col("rank") + c)), 9).alias("score"))
    return ranked(scores, k, F.desc("score"))


def _weighed(vector: DataFrame, keyword: DataFrame, own: Column, weights: tuple[float, float], k: int) -> DataFrame:
    parts = [x.select("query_id", "chunk_id", own.alias("own")).withColumn("own", F.col("own") * w) for x, w in zip((vector, keyword), weights, strict=True)]
    scores = parts[0].union(parts[1]).groupBy("query_id", "chunk_id").agg(F.bround(F.sum("own"), 9).alias("score"))
    return ranked(scores, k, F.desc("score"))


def weighted(vector: DataFrame, keyword: DataFrame, k: int = 10, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Scores brought to 0..1 in each list, 1 where all are equal, then weighed."""
    low, high = F.min("score").over(_query()), F.max("score").over(_query())
    return _weighed(vector, keyword, F.when(high <= low, 1.0).otherwise((F.col("score") - low) / (high - low)), weights, k)


def rank_normalised(vector: DataFrame, keyword: DataFrame, k: int = 10, weights: tuple[float, float] = (0.5, 0.5)) -> DataFrame:
    """Places brought to 1 for the first down to 1/n for the last, then weighed."""
    n = F.count("*").over(_query())
    return _weighed(vector, keyword, (n - F.col("rank") + 1) / n, weights, k)


def current_merge(vector: DataFrame, keyword: DataFrame, k: int = 10, cap: int = 30) -> DataFrame:
    pool = capped(merged(vector, keyword), cap)
    return pool.where(F.col("ord") <= k).withColumnRenamed("ord", "rank")


STRATEGIES = {"current_merge": current_merge, "rrf": reciprocal_rank, "weighted": weighted, "rank_normalized": rank_normalised}


def fuse(name: str, vector: DataFrame, keyword: DataFrame, **params) -> DataFrame:
    if name not in STRATEGIES:
        raise ValueError(f"unknown fusion strategy {name}")
    return STRATEGIES[name](vector, keyword, **params)
