"""Writes that may be repeated: each function gives the rows to append or the table after a change, as a DataFrame, so
that any table format can take it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls

#: What makes an embedding row the same row.
IDENTITY = ("chunk_id", "chunking_algorithm_version", "embedding_input_manifest", "embedding_model", "embedding_model_revision")


def new_rows(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose keys are not stored, each key once; a second run gives none."""
    return incoming.dropDuplicates(keys).join(stored.select(*keys).distinct(), keys, "left_anti")


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str] | tuple[str, ...] = IDENTITY, force: bool = False) -> DataFrame:
    """The table after an upsert: stored rows win, or incoming ones with force."""
    keys = list(keys)
    if force:
        return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming.dropDuplicates(keys))
    return stored.unionByName(new_rows(stored, incoming, keys))


def replaced(stored: DataFrame, incoming: DataFrame, key: str, order: str, index: str = "chunk_index") -> DataFrame:
    """The table with all rows of the incoming documents replaced, their rows numbered anew from 0."""
    numbered = incoming.withColumn(index, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(numbered)


def only_version(stored: DataFrame, column: str, live: str) -> DataFrame:
    """The table without rows of other versions."""
    return stored.where(F.col(column) == live)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last written row of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def versions(rows: DataFrame, key: str, order: str, content_hash: str) -> DataFrame:
    """Adds `version`, which rises where the content changes, and `is_current`, true for the highest version's last row."""
    own = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((F.lag(content_hash).over(own) != F.col(content_hash)).cast("int"), F.lit(0))
    numbered = rows.withColumn("_c", changed).withColumn("version", F.sum("_c").over(own) + 1).drop("_c")
    return numbered.withColumn("is_current", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order))) == 1)


def raw_artifacts(pages: DataFrame) -> DataFrame:
    """Crawled pages as immutable artifacts, addressed by their content."""
    url = F.col("url")
    return pages.select("page_id", urls.website(url).alias("website"), urls.normalised(url).alias("canonical_url"), tx.content_hash(F.col("html")).alias("content_hash"), F.col("html").alias("content"))


def url_index(artifacts: DataFrame) -> DataFrame:
    """(website, canonical_url, n_versions, latest_hash): by the order in which pages came."""
    return artifacts.groupBy("website", "canonical_url").agg(F.count_distinct("content_hash").alias("n_versions"), F.max_by("content_hash", "page_id").alias("latest_hash"))


def by_hash(artifacts: DataFrame, hashes: DataFrame) -> DataFrame:
    """The artifacts with the wanted content hashes."""
    return artifacts.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")


def at_version(rows: DataFrame, version: int, column: str = "version") -> DataFrame:
    """The rows of one version; where a key has several of it, all."""
    return rows.where(F.col(column) == version)


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The table without the rows of excluded documents."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def present(stored: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The asked keys with `n`, the number of stored rows of each, and `exists`."""
    n = stored.groupBy(*keys).agg(F.count("*").alias("n"))
    return asked.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("exists"))


def with_status(rows: DataFrame, changes: DataFrame, key: str, status: str = "status", by: str = "changed_by") -> DataFrame:
    """The table after changes (key, status, by): the last named status of a key, by the greatest `by`, replaces its own.
    `changed` says where it is another one."""
    last = changes.groupBy(key).agg(F.max(F.struct(by, status)).alias("_c"))
    return rows.join(last, key, "left").select(*[c for c in rows.columns if c != status], F.coalesce(f"_c.{status}", status).alias(status), F.coalesce(F.col(f"_c.{status}") != F.col(status), F.lit(False)).alias("changed"))


def corpus_manifest(rows: DataFrame, group: str, item: str, content: str) -> DataFrame:
    """(group, n, first, last, fingerprint): each group's number of rows and an order-free fingerprint of its contents.
    Only sums meet, so a group of any size is in no one task."""
    mark = F.conv(F.substring(F.sha2(content, 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.min(item).alias("first"), F.max(item).alias("last"), F.sum(mark).cast("decimal(38,0)").cast("string").alias("fingerprint"))
