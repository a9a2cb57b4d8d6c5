"""Near-duplicate embeddings by an exact metric range join: pivots, far from one another, cut the space into cells, the
triangle inequality says which vectors of other cells a cell must also see, and the cells are joined independently; within
a cell, distances to the next pivot say which blocks of rows need no comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import by_batch, by_group, lowest_share, written

#: Vectors of a chunk: a task holds two chunks.
CHUNK_ROWS = 8192
#: More cells than this would send more pivots than a worker should hold; of fewer vectors, one pivot for so many, up to
#: so many cells.
MOST_PIVOTS = 1024
ROWS_A_PIVOT, FEW_PIVOTS = 32, 12
#: Candidates for each pivot, from which those far from one another are taken.
CANDIDATES = 8
#: Rows of a block of products, on either side.
BLOCK = (512, 2048)


@dataclass(frozen=True)
class Params:
    cosine: float = 0.95

    @property
    def radius(self) -> float:
        """The distance of unit vectors at the least cosine, with room for rounding."""
        return math.sqrt(2 - 2 * self.cosine) + 1e-5


def valid(id_col: str, vec_col: str) -> Column:
    """Rows that may link: an id, and a vector that is not null, empty or zero and whose components are all finite."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(vec_col, lambda x: x != 0), F.lit(False))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def apart(candidates: np.ndarray, n: int) -> np.ndarray:
    """n of the candidates, each as far as can be from those before it; the first is the first."""
    chosen, near = [0], ((candidates - candidates[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(candidates)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    return candidates[chosen]


def blocks(far: np.ndarray, split: int, cross: bool, radius: float) -> Iterator[tuple[slice, slice]]:
    """Blocks of rows that may hold a pair within the radius: of the rows before `split` against those behind it, or, if
    not cross, of all rows against themselves. `far` is each row's distance to one more pivot, sorted on either side; two
    rows whose distances differ by more than the radius can't be near each other."""
    for x in range(0, split if cross else len(far), BLOCK[0]):
        end = min(x + BLOCK[0], split if cross else len(far))
        y = split if cross else x
        y += int(np.searchsorted(far[y:], far[x] - radius))
        last = (split if cross else x) + int(np.searchsorted(far[split if cross else x :], far[end - 1] + radius, "right"))
        for k in range(y, last, BLOCK[1]):
            yield slice(x, end), slice(k, min(k + BLOCK[1], last))


def _cells(distinct: DataFrame, p: Params, kind: str, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(dim, cell, home, rep, mult, v): each vector in its home cell, that of its nearest pivot, and in every earlier
    cell that may hold a vector within the radius. For y at home with pivot h, a vector x at home with pivot c is at
    least (d(y,c)^2 - d(y,h)^2) / (2 d(c,h)) away: the triangle inequality through the plane midway of c and h. A pair
    of different homes so meets once, in the earlier cell."""
    sent = distinct.sparkSession.sparkContext.broadcast(pivots)
    code = "<f4" if "float" in kind else "<f8"

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("dim", "cell", "home", "rep", "mult", "v")}
            for rep, mult, v in zip(batch["rep"].to_pylist(), batch["mult"].to_pylist(), batch["v"].to_pylist(), strict=True):
                own = np.array(v, code)
                u = _unit(own.astype(float)[None])[0]
                centres = sent.value[len(v)]
                d2 = ((centres - u) ** 2).sum(1)
                h = int(d2.argmin())
                between = np.sqrt(((centres[:h] - centres[h]) ** 2).sum(1))
                near = np.flatnonzero(d2[:h] - d2[h] <= 2 * between * p.radius + 1e-9).tolist()
                for cell in [*near, h]:
                    for c, x in zip(out, (len(v), cell, cell == h, rep, mult, own.tobytes()), strict=True):
                        out[c].append(x)
            return out

        return each

    id_kind = dict(distinct.dtypes)["rep"]
    return by_batch(distinct, f"dim int, cell int, home boolean, rep {id_kind}, mult long, v binary", make)


def range_join(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(distinct, found). distinct: (v, rep, mult), each valid vector once, with its smallest id and its number of rows.
    found: (rep, n, to): for each block of a cell and each vector with links in it, how many rows it links with there
    and the smallest vector that its links in the block reach. The sums of n are exact; the edges (rep, to) join the
    same vectors as all links do."""
    kind = dict(vectors.dtypes)[vec_col]
    distinct = written(vectors.where(valid(id_col, vec_col)).groupBy(F.col(vec_col).alias("v")).agg(F.min(id_col).alias("rep"), F.count("*").alias("mult")), "vectors")
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("d").orderBy("h", "rep")
    wanted = {d: max(1, min(MOST_PIVOTS, max(round(n / CHUNK_ROWS), min(FEW_PIVOTS, n // ROWS_A_PIVOT)))) for d, n in sizes.items()}
    some = F.lit(False)
    for d, n in sizes.items():
        some = some | ((F.col("d") == d) & lowest_share(F.col("h"), CANDIDATES * wanted[d], n))
    chosen = distinct.select(F.size("v").alias("d"), F.xxhash64("v").alias("h"), "rep", "v").where(some).withColumn("k", F.row_number().over(order)).where(F.col("k") <= CANDIDATES * max(wanted.values(), default=1))
    rows = sorted(chosen.select("d", "k", "v").collect(), key=lambda r: r["k"])
    pivots = {d: apart(_unit(np.array([r["v"] for r in rows if r["d"] == d and r["k"] <= CANDIDATES * n], float)), n) for d, n in wanted.items()}
    sent = distinct.sparkSession.sparkContext.broadcast(pivots)
    cells = written(_cells(distinct, p, kind, pivots), "cells")
    counts = written(cells.groupBy("dim", "cell").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(F.col("home") == own) / CHUNK_ROWS)).cast("int").alias(n) for n, own in (("gh", True), ("gr", False))], F.count_if(~F.col("home")).alias("n_far")), "counts")
    placed = cells.join(F.broadcast(counts), ["dim", "cell"]).withColumn("salt", F.xxhash64("rep"))  # a row for each cell: at most MOST_PIVOTS a dimension
    home, far = placed.where("home"), placed.where("not home")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own, other = F.pmod("salt", F.col("gh")).cast("int"), every(F.col("gh"))
    both = home.withColumn("own", own).withColumn("o", other).select("dim", "cell", F.lit(0).alias("kind"), F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "rep", "mult", "v")
    left = home.where("n_far > 0").select("dim", "cell", F.lit(1).alias("kind"), own.alias("i"), every(F.col("gr")).alias("j"), F.lit(0).alias("own"), "rep", "mult", "v")
    right = far.select("dim", "cell", F.lit(1).alias("kind"), other.alias("i"), F.pmod("salt", F.col("gr")).cast("int").alias("j"), F.lit(1).alias("own"), "rep", "mult", "v")
    code = "<f4" if "float" in kind else "<f8"

    def join(key: tuple, rows: list[dict]) -> Iterator[dict]:
        cross = key[2] == 1 or key[3] != key[4]
        first = min(r["own"] for r in rows)
        u = _unit(np.array([np.frombuffer(r["v"], code) for r in rows]).astype(float))
        centres, behind = sent.value[key[0]], np.array([r["own"] != first for r in rows])
        home = ((centres - centres[key[1]]) ** 2).sum(1)
        home[key[1]] = np.inf
        far = np.sqrt(((u - centres[home.argmin()]) ** 2).sum(1)) if len(centres) > 1 else np.zeros(len(rows))
        order = np.lexsort((far, behind if cross else np.zeros(len(rows))))
        rows, u, far = [rows[k] for k in order.tolist()], u[order], far[order]
        low = u.astype(np.float32)
        mult = np.array([r["mult"] for r in rows])
        label, n_links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        split = len(rows) - int(behind.sum())
        if cross and split == len(rows):
            return
        for x, y in blocks(far, split, cross, p.radius):
            i, j = np.nonzero(low[x] @ low[y].T >= p.cosine - 1e-5)
            i, j = i + x.start, j + y.start
            if not cross:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65_536):
                a, b = i[k : k + 65_536], j[k : k + 65_536]
                sure = (u[a] * u[b]).sum(1) >= p.cosine
                a, b = a[sure], b[sure]
                n_links += np.bincount(a, mult[b], len(rows)).astype(np.int64) + np.bincount(b, mult[a], len(rows)).astype(np.int64)
                while len(a := a[(new := label[a] != label[b])]):
                    b = b[new]
                    hi, lo = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
                    up = np.arange(len(rows))
                    np.minimum.at(up, hi, lo)
                    label = up[label]
        least = np.full(len(rows), len(rows))
        ids = [r["rep"] for r in rows]
        by_id = np.array(sorted(range(len(rows)), key=ids.__getitem__))
        rank = np.empty(len(rows), np.int64)
        rank[by_id] = np.arange(len(rows))
        np.minimum.at(least, label, rank)
        for r in np.flatnonzero(n_links).tolist():
            yield {"rep": ids[r], "n": int(n_links[r]), "to": ids[by_id[least[label[r]]]]}

    id_kind = dict(distinct.dtypes)["rep"]
    found = by_group(both.union(left).union(right), ["dim", "cell", "kind", "i", "j"], f"rep {id_kind}, n long, to {id_kind}", join)
    return distinct, written(found, "found")


def near_vectors(vectors: DataFrame, p: Params = Params(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for each row. Rows that cannot link (see valid()) have no links and are their
    own component, null for a null id, and are kept. Vectors of different lengths do not link. Equal vectors link with
    each other; rows that repeat an id are counted as rows and share the component."""
    distinct, found = range_join(vectors, p, id_col, vec_col)
    n = found.groupBy("rep").agg(F.sum("n").alias("n"))
    reach = components(found, "rep", "to")
    per = distinct.join(n, "rep", "left").join(reach, distinct["rep"] == reach["node"], "left")
    per = written(per.select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "reach")
    sound = vectors.where(valid(id_col, vec_col)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).join(per, "v").select("id", "n_links", "component_id")
    rest = vectors.where(~valid(id_col, vec_col)).select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return sound.union(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_embedding_dedup(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector at cosine 0.95, as near_vectors() defines them."""
    return near_vectors(embeddings)


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a
)
SELECT e.vec_id, (SELECT count(*) FROM pair p WHERE p.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""
