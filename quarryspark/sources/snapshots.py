"""Tables in versions, on any file system: data files that never change, and a log with one small entry for each version.

A write puts its rows into a fresh folder first; only then is the log entry made, by a rename that fails if another writer
has made it. So readers see the version before or the one after, never a part, and a job that is lost in between leaves
files that no version names. Rows are kept by buckets of their key; a change rewrites the buckets that it touches, and the
new version names the other buckets' files again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made the same version first."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions in the log, from 1."""
    fs, path = _fs(spark, root)
    at = path(f"{root}/log")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def entry(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """The log entry of a version, or of the last one: its number, the files of each bucket, schema, counts and notes."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise KeyError(f"no version {version if version is not None else 'at all'} in {root}; there are {known}")
    name = f"{root}/log/{known[-1] if version is None else version:08d}.json"
    return json.loads("".join(r["value"] for r in spark.read.text(name, wholetext=True).collect()))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version's rows, the last one's by default."""
    found = entry(spark, root, version)
    paths = sorted({p for own in found["buckets"].values() for p in own})
    schema = found["schema"]
    rows = spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in paths]) if paths else spark.createDataFrame([], schema)
    return rows


def history(spark: SparkSession, root: str) -> DataFrame:
    """(version, note, n_rows, n_written, n_buckets_written): the log as a table, the manifest of every version."""
    rows = [(e["version"], e["note"], e["rows"], e["written"], e["touched"]) for e in (entry(spark, root, v) for v in versions(spark, root))]
    return spark.createDataFrame(rows, "version int, note string, n_rows long, n_written long, n_buckets_written int")


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _staged(rows: DataFrame, root: str, keys: list[str], n: int) -> tuple[dict[str, list[str]], int]:
    """Writes rows by bucket into a fresh folder; the paths of each bucket and the number of rows. A bucket of many rows is
    spread over several files, so a hot one is no single task's."""
    spark, name = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = rows.withColumn(BUCKET, _bucket(keys, n))
    dealt.repartition(F.col(BUCKET), F.pmod(F.xxhash64(*keys), F.lit(7))).write.partitionBy(BUCKET).parquet(f"{root}/{name}")
    fs, path = _fs(spark, root)
    found = {s.getPath().getName().split("=")[1]: [f"{name}/{s.getPath().getName()}"] for s in fs.listStatus(path(f"{root}/{name}")) if s.isDirectory()}
    written = spark.read.schema(rows.schema).parquet(*[f"{root}/{p}" for own in found.values() for p in own]).count() if found else 0
    return found, written


def _commit(spark: SparkSession, root: str, own: dict, version: int) -> int:
    fs, path = _fs(spark, root)
    fs.mkdirs(path(f"{root}/log"))
    draft, final = path(f"{root}/log/.{uuid.uuid4().hex}"), path(f"{root}/log/{version:08d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(own | {"version": version}).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, final, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            raise Conflict(f"version {version} of {root} was made by another writer") from e
        raise
    return version


def create(rows: DataFrame, root: str, keys: list[str], buckets: int = 16, note: str = "create") -> int:
    """The first version of a table; Conflict where there is one."""
    spark = rows.sparkSession
    if versions(spark, root):
        raise Conflict(f"{root} has versions")
    found, n = _staged(rows, root, keys, buckets)
    return _commit(spark, root, {"note": note, "buckets": found, "rows": n, "written": n, "touched": len(found), "keys": keys, "n_buckets": buckets, "schema": _ddl(rows), "base": None}, 1)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def changed(spark: SparkSession, root: str, incoming: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], note: str, base: int | None = None) -> int:
    """The next version: change(stored, incoming) of the buckets that incoming rows fall into. `incoming` has the table's
    keys. Other buckets' files are neither read nor written. It is made on `base`, by default the last version; Conflict
    where another one came in between."""
    was = entry(spark, root, base)
    keys, n = was["keys"], was["n_buckets"]
    touched = sorted(r[0] for r in incoming.select(_bucket(keys, n)).distinct().collect())  # n numbers at most
    old = [f"{root}/{p}" for b in touched for p in was["buckets"].get(str(b), [])]
    stored = spark.read.schema(was["schema"]).parquet(*old) if old else spark.createDataFrame([], was["schema"])
    found, written = _staged(change(stored, incoming), root, keys, n)
    kept = {b: own for b, own in was["buckets"].items() if int(b) not in touched}
    gone = stored.count() if old else 0
    own = was | {"note": note, "buckets": kept | found, "rows": was["rows"] - gone + written, "written": written, "touched": len(touched), "base": was["version"]}
    return _commit(spark, root, own, was["version"] + 1)


def upsert(spark: SparkSession, root: str, incoming: DataFrame, base: int | None = None) -> int:
    """Incoming rows replace those of their keys; of incoming rows with one key, any one stays."""
    keys = entry(spark, root, base)["keys"]
    return changed(spark, root, incoming, lambda stored, new: stored.join(new.select(*keys), keys, "left_anti").unionByName(new.dropDuplicates(keys)), "upsert", base)


def delete(spark: SparkSession, root: str, gone: DataFrame, base: int | None = None) -> int:
    """The table without the rows of the keys."""
    keys = entry(spark, root, base)["keys"]
    return changed(spark, root, gone.select(*keys).distinct(), lambda stored, new: stored.join(new, keys, "left_anti"), "delete", base)


def append_new(spark: SparkSession, root: str, incoming: DataFrame, base: int | None = None) -> int:
    """Rows whose keys are not there; stored rows never change, so a write that is repeated adds nothing."""
    keys = entry(spark, root, base)["keys"]
    return changed(spark, root, incoming, lambda stored, new: stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")), "append", base)


def restore(spark: SparkSession, root: str, version: int) -> int:
    """A new version with an old one's files; nothing is copied."""
    old, last = entry(spark, root, version), entry(spark, root)
    return _commit(spark, root, old | {"note": f"restore {version}", "written": 0, "touched": 0, "base": last["version"]}, last["version"] + 1)


def unnamed(spark: SparkSession, root: str) -> list[str]:
    """Folders of data that no version names: what lost jobs left. They may go once no writer is at work."""
    fs, path = _fs(spark, root)
    named = {p.split("/")[1] for v in versions(spark, root) for own in entry(spark, root, v)["buckets"].values() for p in own}
    at = path(f"{root}/data")
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName() not in named) if fs.exists(at) else []


class Registry:
    """Corpora by name: a version of a snapshot table is data, and its loader is registered once."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
        self._loaders[name] = loader

    def register_snapshot(self, name: str, root: str, version: int | None = None) -> None:
        self.register(name, lambda spark: read(spark, root, version))

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(f"unknown corpus {name!r}; registered: {self.names()}")
        return self._loaders[name](spark)

    def names(self) -> list[str]:
        return sorted(self._loaders)
