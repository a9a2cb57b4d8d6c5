"""Where queries keep tables that they write and read back: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under spark.checkpoint.dir. Where that is unset, a local session sets a temporary one; on a cluster it
    would be another folder on each machine, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """rows as a table in that folder, for what several branches of a plan read: it is made once, and lost executors cost
    the tasks that were running."""
    at = folder(rows.sparkSession, tag)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
