"""Quality by nearest-neighbour voting: labelled documents are laid out in a latent-semantic space, broadcast, and compared
with every document by exact blocked cosine products; the nearest vote, weighted by their similarity.

A document is described twice: by its words, and by the shapes of its words (letters by case, digits, and the marks
around them as they are). Both are weighed by log frequency and inverse document frequency, each to length one, so that
neither drowns the other, and a truncated singular value decomposition of the labelled sample projects them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, whole_text

LETTERS = re.compile(r"([^\W\d_])[^\W\d_]*")
DIGITS = re.compile(r"\d+")
#: Documents of the sample in a block of products.
BLOCK = 1024


@dataclass(frozen=True)
class Params:
    #: Dimensions of the latent space, and neighbours that vote (more where several are equally near).
    dims: int = 64
    neighbours: int = 25
    #: The sample: labelled documents of each label, and the longest text among them.
    per_class: int = 2000
    longest: int = 20_000
    #: Words and shapes known: those in at least so many documents of the sample, at most so many of the most frequent.
    least: int = 2
    terms: int = 40_000


@dataclass(frozen=True)
class Model:
    #: word or shape -> row; shapes begin with a space, which no word holds
    rows: dict[str, int]
    idf: np.ndarray
    axes: np.ndarray  # a row a term, float32
    points: np.ndarray  # unit vectors of the labelled documents, float32
    good: np.ndarray  # each one's label, 0 or 1
    weight: np.ndarray  # the share of its label among all labels, by its share in the sample
    prior: float
    neighbours: int


def shape(word: str) -> str:
    """Runs of letters become Aa, aa or AA by the case of their first two, digits 0; other characters stay, 12 at most."""
    runs = LETTERS.sub(lambda m: "".join("A" if c.isupper() else "a" for c in m[0][:2]), word)
    return " " + DIGITS.sub("0", runs)[:12]


def terms(text: str) -> tuple[Counter, Counter]:
    """Words, in small letters and without what is no letter or digit at their ends, and shapes, each with its count."""
    words, shapes = Counter(), Counter()
    for token, n in Counter(text.split()).items():
        words[token.lower()] += n
        shapes[shape(token)] += n
    return words, shapes


def _described(text: str, rows: dict[str, int], idf: np.ndarray, cache: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The known terms of a text and their weights."""
    tokens = Counter(text.split())
    pairs = []
    for token in tokens:
        got = cache.get(token)
        if got is None:
            got = cache[token] = (rows.get(token.lower(), -1), rows.get(shape(token), -1))
        pairs.append(got)
    at = np.array(pairs, np.int64).reshape(-1, 2)
    n = np.fromiter(tokens.values(), float, len(tokens))
    places, weights = [], []
    for side in (0, 1):
        known = at[:, side] >= 0
        own, back = np.unique(at[known, side], return_inverse=True)
        w = np.log1p(np.bincount(back, n[known], len(own))) * idf[own]
        places.append(own)
        weights.append(w / (np.linalg.norm(w) or 1.0))
    return np.concatenate(places), np.concatenate(weights)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 1e-12)


def _axes(docs: list[tuple[np.ndarray, np.ndarray]], n_terms: int, dims: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    q = np.random.default_rng(7).standard_normal((n_terms, min(dims, len(docs), n_terms) + 16))
    for _ in range(4):
        out = np.zeros_like(q)
        for at, w in docs:
            out[at] += w[:, None] * (w @ q[at])
        q, _ = np.linalg.qr(out)
    y = np.array([w @ q[at] for at, w in docs])
    _, _, vt = np.linalg.svd(y, full_matrices=False)
    return (q @ vt[: min(dims, len(docs), n_terms)].T).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model from the documents of at most p.per_class ids of each label (the documented bound of the sample: those with
    the smallest hash of the id; of an id's texts of at most p.longest characters the smallest; of its labels the
    largest). The ids are chosen from the labels alone and sent to the documents, so no text but theirs is moved. Without
    a label or a text, every score is the share of label 1, one half where there is none."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(p.per_class) for y in (0, 1)]
    texts = documents.where(F.col(text_col).isNotNull() & (F.length(text_col) <= p.longest)).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = sorted(texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").groupBy("id", "y").agg(F.min("t").alias("t")).select(F.xxhash64("id"), "y", "t").collect())
    found = [terms(t) for _, _, t in rows]
    spread = Counter(t for pair in found for side in pair for t in side)
    common = sorted((t for t, n in spread.items() if n >= p.least), key=lambda t: (-spread[t], t))[: p.terms]
    if not common:
        return Model({}, np.zeros(0), np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior, p.neighbours)
    place, idf = {t: k for k, t in enumerate(common)}, np.array([1 + math.log((1 + len(rows)) / (1 + spread[t])) for t in common])
    cache: dict[str, tuple[int, int]] = {}
    docs = [_described(t, place, idf, cache) for _, _, t in rows]
    axes = _axes(docs, len(common), p.dims)
    good = np.array([float(y) for _, y, _ in rows])
    share = np.where(good == 1, prior, 1 - prior) / np.where(good == 1, good.mean(), 1 - good.mean())
    return Model(place, idf, axes, _unit(np.array([w @ axes[at] for at, w in docs], np.float32)), good, share, prior, p.neighbours)


def vote(vectors: np.ndarray, m: Model) -> np.ndarray:
    """For each unit vector the labels of its nearest labelled documents, weighted by cosine (none below zero) and by the
    labels' true shares. All that are as near as the last neighbour vote, so ties have no order. No similar document gives
    the prior."""
    if not len(m.points):
        return np.full(len(vectors), m.prior)
    near = np.concatenate([np.round(vectors @ m.points[k : k + BLOCK].T, 5) for k in range(0, len(m.points), BLOCK)], axis=1)
    k = min(m.neighbours, near.shape[1])
    least = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    w = np.where((near >= least) & (near > 0), near, 0).astype(float) * m.weight
    total = w.sum(axis=1)
    share = np.divide(w @ m.good, total, out=np.zeros_like(total), where=total > 0)
    return np.where(total > 0, np.minimum(share, 1.0), m.prior)


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cached: int = 200_000) -> DataFrame:
    """(id, score) of every row and whole text, in one pass. Null texts count as empty; a text without a known word or shape
    has the prior as score; rows that repeat are scored each; an empty table gives no row; other columns are not read."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m, cache = sent.value, {}

        def each(batch: pa.RecordBatch) -> dict:
            out = np.zeros((batch.num_rows, m.axes.shape[1]), np.float32)
            for k, text in enumerate(batch["text"].to_pylist()):
                if len(cache) > cached:  # only a memory bound
                    cache.clear()
                at, w = _described(text, m.rows, m.idf, cache)
                out[k] = w @ m.axes[at]
            return {"id": batch["id"], "score": vote(_unit(out), m)}

        return each

    kind = dict(documents.dtypes)[id_col]
    return by_batch(documents.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), f"id {kind}, score double", make).withColumnRenamed("id", id_col)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels teach nothing: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op11_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, as scored() defines them; nothing is learned from labels of
    held-out ids."""
    out = held_out(F.col("doc_id"))
    model = fit(documents, labels.where(~out))
    return scored(documents, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
