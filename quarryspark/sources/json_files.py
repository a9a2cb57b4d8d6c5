"""JSON as a source: folders of JSON lines or of one document a file, read by a fixed schema. What can't be parsed stays a
row with its raw text and its file, so every line is accounted for; nothing is inferred and no file is opened twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "_corrupt"


def read(spark: SparkSession, path: str | list[str], schema: str | StructType, whole_files: bool = False, pattern: str | None = None) -> DataFrame:
    """The columns of the schema, `_corrupt` (the raw text of what is no JSON object, else null) and `_file`. Folders are
    walked; `pattern` is a glob of file names. With whole_files a file is one document, or an array of them; else each
    line is one. Top-level columns that a query doesn't name are not parsed."""
    columns = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(StructType([*columns.fields, StructField(CORRUPT, StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("recursiveFileLookup", "true").option("multiLine", str(whole_files).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"))


def accounted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_file, n_rows, n_corrupt, n_without_key, n_loaded): what each file gave. A row is loaded if it was parsed and has
    its keys."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    bad = F.col(CORRUPT).isNotNull()
    return rows.groupBy("_file").agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_corrupt"), F.count_if(~bad & missing).alias("n_without_key"), F.count_if(~bad & ~missing).alias("n_loaded"))


def manifest_issues(entries: DataFrame, rows: DataFrame, identity: tuple[str, ...] = ("website", "document_id"), key: str = "chunk_id", broken: Column | None = None) -> DataFrame:
    """(key, issue, n) of a manifest's entries against what was read: `no_key`, `no_identity` (an entry lacks a part of
    it), `duplicate_entry`, `missing` (no row has the key) and `invalid` (a row of it is `broken`, a condition over rows).
    A corpus loads as a whole if there is none."""
    lacks = F.lit(False)
    for part in identity:
        lacks = lacks | (F.coalesce(F.col(part), F.lit("")) == "")
    own = entries.groupBy(key).agg(F.count("*").alias("n"), F.count_if(lacks).alias("n_lacking"))
    held = rows.where(F.col(CORRUPT).isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count_if(broken if broken is not None else F.lit(False)).alias("n_broken"))
    met = own.join(held, key, "left")
    none = F.col(key).isNull() | (F.col(key) == "")
    issue = lambda name, n: F.struct(F.lit(name).alias("issue"), n.cast("long").alias("n"))
    found = F.array(
        F.when(none, issue("no_key", F.col("n"))), F.when(F.col("n_lacking") > 0, issue("no_identity", F.col("n_lacking"))), F.when(~none & (F.col("n") > 1), issue("duplicate_entry", F.col("n"))),
        F.when(~none & F.col("n_broken").isNull(), issue("missing", F.col("n"))), F.when(F.col("n_broken") > 0, issue("invalid", F.col("n_broken"))),
    )
    return met.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def first_by_id(rows: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """The n rows of smallest key; an error where there are fewer, since a benchmark of fewer would be another one."""
    found = rows.orderBy(key).limit(n)
    have = found.count()
    if have < n:
        raise ValueError(f"requested {n} rows but only {have} are there")
    return found


def dataset_issues(datasets: DataFrame, items: str = "conversations", key: str = "conversation_id") -> DataFrame:
    """(_file, issue, n) of generated datasets, one document a file with `count` and an array of items: corrupt files, counts
    that aren't the items' number, and ids that repeat."""
    n, ids = F.coalesce(F.size(items), F.lit(0)), F.transform(items, lambda x: x[key])
    repeats = F.size(ids) - F.size(F.array_distinct(ids))
    found = F.array(
        F.when(F.col(CORRUPT).isNotNull(), F.struct(F.lit("corrupt").alias("issue"), F.lit(1).alias("n"))),
        F.when(F.col(CORRUPT).isNull() & (F.coalesce("count", F.lit(-1)) != n), F.struct(F.lit("count").alias("issue"), n.alias("n"))), F.when(F.col(CORRUPT).isNull() & (repeats > 0), F.struct(F.lit("repeated_id").alias("issue"), repeats.alias("n"))),
    )
    return datasets.select("_file", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("_file", "x.*")


def completed(results: DataFrame, key: str, order: str) -> DataFrame:
    """The last result of each key, of a file to which every run appends; corrupt lines, of a run that was cut off, count as
    not done."""
    sound = results.where(F.col(CORRUPT).isNull() & F.col(key).isNotNull())
    own = [c for c in sound.columns if c not in (CORRUPT, "_file")]
    return sound.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(order, F.xxhash64(*own))).alias("r")).select("r.*")


def pending(asked: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: a run that is started again goes on from there."""
    return asked.join(done.select(key).distinct(), key, "left_anti")


def append(rows: DataFrame, path: str) -> None:
    """Adds rows as JSON lines; what is there stays."""
    rows.write.mode("append").json(path)
