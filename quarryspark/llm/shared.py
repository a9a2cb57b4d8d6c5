"""What the operators of this package share: the shared folder, written intermediate tables and whole-text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. With texts of up to some hundred thousand characters this keeps a batch at tens of MB.
ROWS_PER_BATCH = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session, as in tests,
    sets a temporary one; on a cluster that would be another folder on each machine, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder. It cuts the lineage, survives lost executors and, read again, is
    dealt out anew by a join, so that adaptive execution may split a hot key."""
    path = fresh_path(df.sparkSession, tag)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get ROWS_PER_BATCH rows at a time, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored; where it has fewer files than there are cores, its rows are dealt out one partition a core, as
    a small file is one row group and so one task. A table of more files is never shuffled for it."""
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and len(rows.inputFiles()) < cores else rows


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def by_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """mapInArrow with state made once in each task: make() gives the function from a batch to columns."""
    bounded_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (columns := each(batch)) is not None:
                yield pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def by_group(df: DataFrame, keys: list[str], schema: str, each_group: Callable[[tuple, list[dict]], Iterator[dict]]) -> DataFrame:
    """each_group(key, rows) for the rows of each key. The rows come sorted within their partition and are read in
    bounded batches; a task holds one group at a time, so the caller must bound the groups (chunks of hot keys)."""
    bounded_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                yield from batch.to_pylist()

        out: list[dict] = []
        for key, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
            out += each_group(key, list(group))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def paired_chunks(df: DataFrame, salt: Column, chunks: Column, i: str = "i", j: str = "j", own: str = "own") -> DataFrame:
    """Deals the rows of a large group into pairs of chunks, so that any two rows of it meet in one bounded task: a row
    of chunk c goes to (c, d) for every chunk d. `own` is the row's chunk; one chunk gives just (0, 0)."""
    c = F.pmod(salt, chunks)
    d = F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int")))
    return df.withColumn(own, c.cast("int")).withColumn("_d", d).withColumn(i, F.least(own, "_d")).withColumn(j, F.greatest(own, "_d")).drop("_d")


def lowest_share(h: Column, n: int | Column, total: int | Column) -> Column:
    """Whether a 64-bit hash is among so low ones that about 2 n + 100 of `total` rows are: the n lowest are among them
    but for a chance of 1e-20. It bounds what is ranked to choose n rows."""
    share = F.least(F.lit(1.0), (2.0 * n + 100) / F.greatest(F.lit(1.0), F.lit(total) if isinstance(total, int) else total))
    return F.coalesce(h / F.lit(2.0**64) + 0.5 <= share, F.lit(False))


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """df, marked for broadcast if its counted rows stay within the limit; else joins shuffle it. df is a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
