"""Centroid clustering in exact integers, with ns-bounds: a vector keeps the exact distance to each centroid as it was
when last evaluated, and the round of that. The history of the centroids is kept, and a bound is loosened by the norm of
the centroid's total displacement since then, not by the sum of its steps. A vector whose bounds don't settle its centroid
is evaluated anew, exactly, against the centroids that may win.

The state of the vectors is a table, written anew in each round and removed when the next one stands, so that lost
executors cost a task. The driver holds centroids and sums: k times the number of components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, by_batch, fresh_path, removed

#: Components beyond this leave the 64 bits of a squared distance.
MOST = 1 << 27


@dataclass(frozen=True)
class Params:
    k: int = 8
    rounds: int = 10
    dim: int = 64
    #: Components become floor(scale * x).
    scale: int = 1024
    #: Before an id in the hash that chooses the first centroids.
    seed: str = "3:"


def keepable(vec_col: str, p: Params) -> Column:
    """Vectors of p.dim components, none of which is null or not finite; nor may an integer be beyond MOST."""
    return F.coalesce((F.size(vec_col) == p.dim) & F.forall(vec_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < MOST / p.scale), F.lit(False))), F.lit(False))


def _integers(column: pa.Array, p: Params) -> np.ndarray:
    return np.floor(p.scale * column.flatten().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64).reshape(-1, p.dim)


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def settle(v: np.ndarray, own: np.ndarray, d: np.ndarray, at: np.ndarray, history: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest of the last centroids for each vector, of equal ones the smallest, and the number of distances that had
    to be evaluated. own: its centroid before; d, at: squared distances as last evaluated and the rounds of that, which are
    renewed in place. history: the centroids of all rounds. Bounds are floats with room for rounding; what they leave open
    is settled in integers, so the result is exact."""
    now, centres = len(history) - 1, history[-1]
    gone = np.sqrt(((history[:-1] - centres) ** 2).sum(2).astype(float)) if now else np.zeros((0, len(centres)))
    gone = np.concatenate([gone, np.zeros((1, len(centres)))])[at, np.arange(len(centres))]
    low, every = np.sqrt(d.astype(float)) - gone, np.arange(len(v))
    high = np.sqrt(d[every, own].astype(float)) + gone[every, own]
    low[every, own] = np.inf
    fails = np.flatnonzero(high + 1e-6 + 1e-9 * high >= low.min(axis=1))
    if not len(fails):
        return own, 0
    mine = own[fails]
    exact = _squared(v[fails], centres[mine])
    d[fails, mine], at[fails, mine] = exact, now
    high = np.sqrt(exact.astype(float))
    may = low[fails] <= (high + 1e-6 + 1e-9 * high)[:, None]
    r, j = np.nonzero(may)
    d[fails[r], j], at[fails[r], j] = _squared(v[fails[r]], centres[j]), now
    may[np.arange(len(fails)), mine] = True
    best = np.where(may, d[fails], np.iinfo(np.int64).max).argmin(axis=1)
    out = own.copy()
    out[fails] = best
    return out, len(fails) + len(r)


def _first(vectors: DataFrame, p: Params) -> np.ndarray:
    """The vectors of smallest hash, in its order. Rows without an id have no hash and come last."""
    h = F.sha2(F.concat(F.lit(p.seed), F.col("id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(h.asc_nulls_last(), "v").limit(p.k).select("v").collect()
    return np.array([[int(x) for x in np.floor(p.scale * np.array(r["v"], float))] for r in rows], np.int64).reshape(-1, p.dim)


def _sums(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to each centroid's sum of components, and to its number of vectors;
    Python integers. A task gives k rows for each component."""
    ddl = "cluster int, place int, x decimal(38,0)"
    arrow = arrow_schema(state.sparkSession, "cluster int, place int, x long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            v = np.frombuffer(b"".join(batch["v"].to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], axis=1)
            own, was = batch["cluster"].to_numpy(), batch["was"].to_numpy()
            for c in range(k):
                total[c] += v[own == c].sum(axis=0) - v[was == c].sum(axis=0)
        c, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(place, pa.int32()), pa.array(total[c, place])], schema=arrow)

    moved = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "cluster int, place int, x long")
    out = np.zeros((k, dim + 1), object)
    for c, place, x in moved.select("cluster", "place", F.col("x").cast("decimal(38,0)").alias("x")).groupBy("cluster", "place").agg(F.sum("x")).collect():
        out[c, place] = int(x)
    return out[:, :dim], out[:, dim]


def cluster(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that keepable() keeps, and the last centroids. The rounds end early when no
    vector moves, as all later ones would be alike. Rows that repeat are clustered each; null ids are clustered, but never
    start a centroid while other vectors do; fewer vectors than centroids make fewer centroids; an empty table gives no
    row. Of other columns none is read."""
    spark = vectors.sparkSession
    rows = vectors.where(keepable(vec_col, p)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    history = _first(rows, p)[None]
    k, kind = len(history[0]), dict(rows.dtypes)["id"]
    if not k:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).where("false"), history[0]
    ddl = f"id {kind}, v binary, cluster int, was int, d binary, at binary"

    def packed(batch: pa.RecordBatch, v: np.ndarray, own: np.ndarray, was: np.ndarray, d: np.ndarray, at: np.ndarray) -> dict:
        return {"id": batch["id"], "cluster": own.astype(np.int32), "was": was.astype(np.int32), "v": [x.tobytes() for x in v.astype(np.int32)], "d": [x.tobytes() for x in d], "at": [x.tobytes() for x in at.astype(np.int16)]}

    def begin():
        centres = history[0]

        def each(batch: pa.RecordBatch) -> dict:
            v = _integers(batch["v"], p)
            d = np.stack([_squared(v, c) for c in centres], axis=1)
            return packed(batch, v, d.argmin(axis=1), np.full(len(v), -1), d, np.zeros(d.shape, np.int16))

        return each

    def again(past: np.ndarray):
        def make():
            def each(batch: pa.RecordBatch) -> dict:
                v, d, at = (np.frombuffer(b"".join(batch[c].to_pylist()), kind).reshape(batch.num_rows, -1) for c, kind in (("v", np.int32), ("d", np.int64), ("at", np.int16)))
                v, d, at, was = v.astype(np.int64), d.copy(), at.copy(), batch["cluster"].to_numpy().astype(np.int64)
                return packed(batch, v, settle(v, was, d, at, past)[0], was, d, at)

            return each

        return make

    def stored(df: DataFrame) -> tuple[str, DataFrame]:
        df.write.parquet(path := fresh_path(spark, "state"))
        return path, spark.read.schema(ddl).parquet(path)

    path, state = stored(by_batch(rows, ddl, begin))
    sums, sizes = np.zeros((k, p.dim), object), np.zeros(k, object)
    for _ in range(p.rounds):
        more, n = _sums(state, k, p.dim)
        if not more.any() and not n.any():
            break
        sums, sizes = sums + more, sizes + n
        centres = np.array([[int(x) // int(m) for x in s] if m else old.tolist() for s, m, old in zip(sums, sizes, history[-1], strict=True)], np.int64)
        history = np.concatenate([history, centres[None]])
        before, (path, state) = path, stored(by_batch(state, ddl, again(history)))
        removed(spark, before)
    last = history[-1]

    def finish():
        def each(batch: pa.RecordBatch) -> dict:
            v, own = np.frombuffer(b"".join(batch["v"].to_pylist()), np.int32).reshape(-1, p.dim).astype(np.int64), batch["cluster"].to_numpy()
            return {"id": batch["id"], "cluster": own, "distance": _squared(v, last[own])}

        return each

    return by_batch(state.select("id", "v", "cluster"), f"id {kind}, cluster int, distance long", finish), last


def op13_clustering(embeddings: DataFrame, p: Params = Params()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector, as cluster() defines
    them."""
    found, centres = cluster(embeddings, p)
    spark = embeddings.sparkSession
    sums = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    rows = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centres)]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(p: Params = Params()) -> str:
    near = lambda c: f"list_sum(list_transform(list_zip(e.v, {c}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {p.dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{p.seed}' || vec_id), v) - 1 AS j, v FROM e QUALIFY j < {p.k})",
    ]
    for t in range(p.rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT e.vec_id, e.v, c.j, {near('c')}::BIGINT AS d FROM e, c{t} c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY d, c.j) = 1)")
        if t < p.rounds:
            steps.append(f"s{t} AS (SELECT j, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{t}, (SELECT unnest(generate_series(1, {p.dim})) AS i) GROUP BY j, i)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.v, c.v) AS v FROM c{t} c LEFT JOIN (SELECT j, list(x ORDER BY i) AS v FROM s{t} GROUP BY j) n USING (j))")
    last = f"a{p.rounds}", f"c{p.rounds}"
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, a.j::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last[0]} a JOIN {last[1]} c ON a.j = c.j"""


ORACLE = _oracle()
