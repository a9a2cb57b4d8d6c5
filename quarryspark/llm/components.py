"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v. The large star ties each larger neighbour of a node to the node's
    smallest neighbour; the small star ties a node and its smaller neighbours to the smallest of them."""
    near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = written(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    tied = near.join(least, "u")
    if both_ways:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an edge table, component being the smallest node that it reaches.

    Nodes are comparable ids. Every step is a grouped minimum (partly summed before its shuffle) and a join with that
    minimum from a written table, so a node with very many links is split by adaptive execution. The driver sees two
    numbers a step. The number of steps grows with the logarithm of the longest path. Null ids and loops are ignored.
    """
    edges = written(
        edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    sign = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    before = edges.agg(sign.alias("s")).first()["s"]
    while before["n"]:
        edges = written(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(sign.alias("s")).first()["s"]
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
