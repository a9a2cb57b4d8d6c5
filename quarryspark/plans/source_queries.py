"""Registered queries of JSON sources and of tables in versions: what is written is read back and accounted for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import json_files, scratch, snapshots
from ..sources.tables import table

PAGE = "page_id long, url string, body string"


def _page_files(spark, root):
    """The pages as JSON lines in a folder a part, every seventh line cut off and every eleventh without its id."""
    pages = table(spark, root, "pages").select("page_id", "url", F.left("html", F.lit(400)).alias("body"))
    full = F.to_json(F.struct(F.when(F.col("page_id") % 11 != 0, F.col("page_id")).alias("page_id"), "url", "body"))
    line = F.when(F.col("page_id") % 7 == 3, F.left(full, F.lit(25))).otherwise(full)
    at = scratch.folder(spark, "pages")
    pages.select((F.col("page_id") % 5).alias("part"), line.alias("value")).repartition("part").write.partitionBy("part").text(at)
    return at


def json_pages(spark, root):
    """Every row of the files, by what became of it."""
    rows = json_files.read(spark, _page_files(spark, root), PAGE)
    state = F.when(F.col("_corrupt").isNotNull(), "corrupt").when(F.col("page_id").isNull(), "without_key").otherwise("loaded")
    return rows.select("page_id", "url", F.sha2("body", 256).alias("body_sha256"), state.alias("state"), F.regexp_extract("_file", "part=([0-9]+)", 1).cast("int").alias("part"))


def json_accounts(spark, root):
    found = json_files.accounted(json_files.read(spark, _page_files(spark, root), PAGE), ["page_id"])
    part = F.regexp_extract("_file", "part=([0-9]+)", 1).cast("int").alias("part")
    return found.groupBy(part).agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_corrupt", "n_without_key", "n_loaded")])


def json_pending(spark, root):
    """Pages that a run, which was cut off and started again, still has to do: its results are lines, some cut off."""
    at = scratch.folder(spark, "results")
    pages = table(spark, root, "pages").select("page_id", F.length("html").alias("n"))
    for run, share in ((1, 2), (2, 3)):
        full = F.to_json(F.struct("page_id", F.lit(run).alias("run"), (F.col("n") * run).alias("n")))
        pages.where(F.col("page_id") % share == 0).select(F.when(F.col("page_id") % 13 == 0, F.left(full, F.lit(12))).otherwise(full).alias("value")).write.mode("append").text(at)
    done = json_files.completed(json_files.read(spark, at, "page_id long, run int, n long"), "page_id", "run")
    todo = json_files.pending(pages, done, "page_id").select("page_id", F.lit(None).cast("int").alias("run"), F.lit(None).cast("long").alias("n"))
    return done.union(todo)


def manifest_issues(spark, root):
    """A manifest of the pages with entries twice, without keys and of pages that are not there, against what was read."""
    rows = json_files.read(spark, _page_files(spark, root), PAGE).withColumn("chunk_id", F.col("page_id").cast("string"))
    entries = table(spark, root, "pages").select(F.col("page_id").alias("i"), F.regexp_extract("url", "//([^/]+)/", 1).alias("website"))
    entries = entries.select("*", F.explode(F.when(F.col("i") % 6 == 1, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("k"))
    entries = entries.select(F.when(F.col("i") % 19 == 2, F.lit(None).cast("string")).otherwise(F.col("i").cast("string")).alias("chunk_id"), "website", F.when(F.col("i") % 17 != 4, F.col("i").cast("string")).alias("document_id"))
    return json_files.manifest_issues(entries, rows, broken=F.length("url") % 9 == 0)


def snapshot_versions(spark, root):
    """The rows of three versions of the pages: all; those of even number changed and some new ones; without every third."""
    at = scratch.folder(spark, "snapshots")
    pages = table(spark, root, "pages").select("page_id", tx.content_hash(F.col("html")).alias("content_hash"))
    snapshots.create(pages, at, ["page_id"], buckets=8)
    new = pages.where("page_id % 2 = 0").select("page_id", F.concat(F.lit("new:"), F.right("content_hash", F.lit(8))).alias("content_hash"))
    snapshots.upsert(spark, at, new.union(pages.where("page_id % 10 = 1").select(F.col("page_id") + 1_000_000, "content_hash")))
    snapshots.delete(spark, at, pages.where("page_id % 3 = 0"))
    out = [snapshots.read(spark, at, v).select(F.lit(v).alias("version"), "page_id", "content_hash") for v in snapshots.versions(spark, at)]
    return out[0].union(out[1]).union(out[2])


def snapshot_history(spark, root):
    """What a change of one bucket writes: the log of a table of 16 buckets after pages of one bucket were replaced."""
    at = scratch.folder(spark, "history")
    pages = table(spark, root, "pages").select("page_id", F.length("html").alias("n"))
    snapshots.create(pages, at, ["page_id"])
    snapshots.upsert(spark, at, pages.where("page_id = 3").withColumn("n", F.lit(0)))
    snapshots.append_new(spark, at, pages.where("page_id < 5"))
    snapshots.restore(spark, at, 1)
    found = snapshots.history(spark, at)
    return found.select("version", "note", "n_rows", (F.col("n_buckets_written") <= F.when(F.col("version") == 2, 1).otherwise(16)).alias("only_touched"))


QUERIES = {
    "json_pages": json_pages, "json_accounts": json_accounts, "json_pending": json_pending, "manifest_issues": manifest_issues, "snapshot_versions": snapshot_versions, "snapshot_history": snapshot_history,
}

_STATE = "CASE WHEN page_id % 7 = 3 THEN 'corrupt' WHEN page_id % 11 = 0 THEN 'without_key' ELSE 'loaded' END"
_HASH = "'sha256:' || sha256(html)"
ORACLE_SQL = {
    "json_pages": f"SELECT CASE WHEN state = 'loaded' THEN page_id END AS page_id, CASE WHEN state <> 'corrupt' THEN url END AS url, CASE WHEN state <> 'corrupt' THEN sha256(left(html, 400)) END AS body_sha256, state, part FROM (SELECT *, {_STATE} AS state, (page_id % 5)::INT AS part FROM pages)",
    "json_accounts": f"SELECT (page_id % 5)::INT AS part, count(*) AS n_rows, count(*) FILTER (state = 'corrupt') AS n_corrupt, count(*) FILTER (state = 'without_key') AS n_without_key, count(*) FILTER (state = 'loaded') AS n_loaded FROM (SELECT *, {_STATE} AS state FROM pages) GROUP BY 1",
    "json_pending": "SELECT page_id, CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 2 WHEN page_id % 2 = 0 THEN 1 END AS run, CASE WHEN page_id % 13 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 2 * length(html) WHEN page_id % 2 = 0 THEN length(html) END AS n FROM pages",
    "manifest_issues": f"""WITH e AS (SELECT CASE WHEN page_id % 19 <> 2 THEN page_id::VARCHAR END AS chunk_id, regexp_extract(url, '//([^/]+)/', 1) AS website, CASE WHEN page_id % 17 <> 4 THEN page_id END AS document_id, unnest(CASE WHEN page_id % 6 = 1 THEN [0, 0] ELSE [0] END) AS k FROM pages),
o AS (SELECT chunk_id, count(*) AS n, count(*) FILTER (website = '' OR document_id IS NULL) AS lacking FROM e GROUP BY 1), r AS (SELECT page_id::VARCHAR AS chunk_id, length(url) % 9 = 0 AS broken FROM pages WHERE {_STATE} = 'loaded'),
m AS (SELECT o.*, broken FROM o LEFT JOIN r USING (chunk_id))
SELECT chunk_id, 'no_key' AS issue, n FROM m WHERE chunk_id IS NULL UNION ALL SELECT chunk_id, 'no_identity', lacking FROM m WHERE lacking > 0 UNION ALL SELECT chunk_id, 'duplicate_entry', n FROM m WHERE chunk_id IS NOT NULL AND n > 1 UNION ALL SELECT chunk_id, 'missing', n FROM m WHERE chunk_id IS NOT NULL AND broken IS NULL UNION ALL SELECT chunk_id, 'invalid', 1 FROM m WHERE broken""",
    "snapshot_versions": f"""WITH a AS (SELECT page_id, {_HASH} AS h FROM pages), b AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'new:' || right(h, 8) ELSE h END AS h FROM a UNION ALL SELECT page_id + 1000000, h FROM a WHERE page_id % 10 = 1)
SELECT 1 AS version, page_id, h AS content_hash FROM a UNION ALL SELECT 2, page_id, h FROM b UNION ALL SELECT 3, page_id, h FROM b WHERE NOT (page_id IN (SELECT page_id FROM a WHERE page_id % 3 = 0))""",
    "snapshot_history": "SELECT * FROM (SELECT count(*) AS n_rows, true AS only_touched FROM pages), (VALUES (1, 'create'), (2, 'upsert'), (3, 'append'), (4, 'restore 1')) v(version, note)",
}
