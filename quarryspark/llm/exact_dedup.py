"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checked_broadcast, written

#: Runs of these characters count as one space.
SPACE = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(id, keep_id, group_size, text_sha256) for the rows whose normalised text another row has too.

    Level 1 groups by length, level 2 by a hash of the first characters within the lengths that occur more than once,
    and only rows whose (length, prefix) is shared are joined with their text again and hashed in full. Each level is
    a grouped count, summed before its shuffle, then a join with the written table of what is shared: that table is sent
    to the rows if it is counted to be small, else the join shuffles, and adaptive execution splits a hot length or copy. Groups are defined by the SHA-256 of the normalised text.

    A null text counts as empty; rows with a null id form no group; rows that repeat an id are copies of one another
    if their texts agree (group_size counts rows).
    """
    text = normalised(F.col(text_col))
    narrow = written(
        documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix_chars)).alias("p")),
        "narrow",
    )
    lengths = written(narrow.groupBy("n").count().where("count > 1").select("n"), "lengths")
    prefixes = written(narrow.join(checked_broadcast(lengths, 16), "n", "left_semi").groupBy("n", "p").count().where("count > 1").select("n", "p"), "prefixes")
    survivors = written(narrow.join(checked_broadcast(prefixes, 32), ["n", "p"], "left_semi").select("id").distinct(), "survivors")
    full = written(
        documents.select(F.col(id_col).alias("id"), text_col).join(checked_broadcast(survivors, 24), "id", "left_semi").select("id", F.sha2(text, 256).alias("text_sha256")), "full"
    )
    groups = written(full.groupBy("text_sha256").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    return full.join(checked_broadcast(groups, 160), "text_sha256").select(F.col("id").alias(id_col), "keep_id", "group_size", "text_sha256").distinct()


def op1_exact_dedup(documents: DataFrame) -> DataFrame:
    """The contract's digest: every row, dropped ones too. A row outside all groups keeps itself."""
    groups = exact_groups(documents).withColumnRenamed("doc_id", "g_id").withColumnRenamed("text_sha256", "g_sha")
    every = documents.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    joined = every.join(groups, (F.col("doc_id") == F.col("g_id")) & (F.col("text_sha256") == F.col("g_sha")), "left")
    keep = F.coalesce("keep_id", "doc_id")
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == keep, F.lit(True)).alias("kept"), "text_sha256")


def kept_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents without the rows of a group whose id isn't the smallest; all columns stay. Rows that repeat both an id
    and its text stay or go together; rows with a null id stay."""
    groups = exact_groups(documents, id_col, text_col)
    dropped = groups.where(F.col(id_col) != F.col("keep_id")).select(id_col).distinct()
    return documents.join(dropped, id_col, "left_anti").select(documents.columns)


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
