"""A corpus as a tree of digests over ranges of its keys' hashes: equal roots mean equal corpora, and two trees are compared
from the root down, so that a change is found without comparing all rows.

A leaf is a prefix of hexadecimal digits of the key's hash; its digest is made of an order-free sum of its rows' hashes
and their number, so rows are only summed, never sorted or gathered. A node above is the hash of its children's digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Digits of a leaf: 16 ** DIGITS leaves, and as many levels above them.
DIGITS = 2
LEAF = "leaf"


def leaf_of(key: str, digits: int = DIGITS) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1, digits)


def row_mark(columns: list[str]) -> Column:
    """A row's hash: null and empty values differ, and no two values run together."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def tree(rows: DataFrame, key: str, columns: list[str], digits: int = DIGITS) -> DataFrame:
    """(level, node, n, digest): the leaves at level `digits`, the root at level 0 as node ''. One shuffle of leaf sums; the
    levels above are made of at most 16 ** digits rows. An empty table has no node."""
    number = lambda at: F.conv(F.substring(F.col("mark"), at, 14), 16, 10).cast("decimal(38,0)")
    marked = rows.select(leaf_of(key, digits).alias("node"), row_mark([key, *columns]).alias("mark"))
    sums = marked.groupBy("node").agg(F.count("*").alias("n"), F.sum(number(1)).cast("decimal(38,0)").cast("string").alias("a"), F.sum(number(15)).cast("decimal(38,0)").cast("string").alias("b"))
    level = sums.select("node", "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), "a", "b"), 256).alias("digest"))
    out = level.select(F.lit(digits).alias("level"), "node", "n", "digest")
    for k in range(digits - 1, -1, -1):
        child = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"], F.lit("="), x["digest"])), ",")
        level = level.groupBy(F.substring("node", 1, k).alias("up")).agg(F.sum("n").alias("n"), F.sha2(child, 256).alias("digest")).select(F.col("up").alias("node"), "n", "digest")
        out = out.union(level.select(F.lit(k).alias("level"), "node", "n", "digest"))
    return out


def changed_leaves(before: DataFrame, after: DataFrame, digits: int = DIGITS) -> list[str]:
    """The leaves in which two trees differ, from the root down: at each level only children of nodes that differ are
    looked at. At most 16 ** digits names come to the driver."""
    differ = [""]
    for k in range(digits + 1):
        own = [t.where((F.col("level") == k) & F.substring("node", 1, max(0, k - 1)).isin(differ)).select("node", "digest") for t in (before, after)]
        met = own[0].withColumnRenamed("digest", "was").join(own[1], "node", "full")
        differ = [r["node"] for r in met.where(~F.col("was").eqNullSafe(F.col("digest"))).select("node").collect()]
        if not differ:
            return []
    return sorted(differ)


def freeze(rows: DataFrame, path: str, key: str, columns: list[str], check: Callable[[DataFrame], DataFrame] | None = None, digits: int = DIGITS) -> dict:
    """Writes a corpus by leaves and its tree under path, and gives its count, digest and number of issues; `check` gives
    the issues of the rows. A path that is there is an error: what is frozen doesn't change."""
    spark = rows.sparkSession
    rows.select(key, *columns, leaf_of(key, digits).alias(LEAF)).repartition(LEAF).write.partitionBy(LEAF).parquet(f"{path}/rows")
    stored = spark.read.schema(rows.select(key, *columns, F.lit("").alias(LEAF)).schema).parquet(f"{path}/rows")
    tree(stored, key, columns, digits).write.parquet(f"{path}/tree")
    top = spark.read.parquet(f"{path}/tree").where("level = 0").first()
    return {"n": top["n"] if top else 0, "digest": top["digest"] if top else None, "issues": check(stored).count() if check else 0}


def frozen_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/tree")


def unchanged(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_after, unchanged) of two trees, by their roots."""
    top = lambda t, n: t.where("level = 0").select(F.lit(1).alias("k"), F.col("n").alias(f"n_{n}"), F.col("digest").alias(n))
    met = top(before, "before").join(top(after, "after"), "k", "full")
    return met.select(F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), F.col("before").eqNullSafe(F.col("after")).alias("unchanged"))


def leaves(spark: SparkSession, path: str, names: list[str], like: DataFrame) -> DataFrame:
    """The rows of some leaves of a frozen corpus; other leaves' files are not opened."""
    rows = spark.read.schema(like.schema.add(LEAF, "string") if LEAF not in like.columns else like.schema).parquet(f"{path}/rows")
    return rows.where(F.col(LEAF).isin(names or [""]))


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of rows, one a key, of two states of some leaves: added, removed or changed."""
    a = before.select(key, row_mark([key, *columns]).alias("was"))
    b = after.select(key, row_mark([key, *columns]).alias("now"))
    met = a.join(b, key, "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return met.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))
