"""Readers of the engine's tables. Column pruning and predicates reach the Parquet scan; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables by the part they play.
TABLES = ("documents", "pages", "embeddings", "benchmark", "labels", "conversations", "events", "orders", "customer", "lineitem", "part", "supplier", "nation", "region")


#: Tables of texts, whose rows cost far more to work on than to move.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table as stored; texts in fewer files than there are cores are dealt out first (see dealt_out)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    rows = spark.read.parquet(f"{root}/{name}.parquet")
    return dealt_out(rows) if name in TEXTS else rows


def dealt_out(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of fewer files than the cluster has cores, one partition a core: a small file is one row group and would be
    one task. A table of more files stays as it is, so large tables are never shuffled for it. Without keys the rows are
    sorted in their task before they are dealt in turn; by keys that differ from row to row nothing is sorted or held."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *keys) if len(rows.inputFiles()) < cores else rows
