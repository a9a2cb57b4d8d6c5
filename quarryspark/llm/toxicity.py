"""Toxicity by compression distance: two zstandard dictionaries, trained on toxic and on ordinary text, compress each
window of some words; the difference of the lengths says which text the window is like.

As zstandard codes a match of five letters in about as many bytes, windows are spelled in a wider alphabet first: each
character becomes a four-byte hash of itself and the two before it in its word. A run that a dictionary knows then
outweighs what its match costs, and short chance matches do not occur. No word is chosen or left out: both dictionaries
are trained on whole texts, and every word of a text is in one window.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .shared import by_batch, whole_text

WORDS = re.compile(r"[^\W\d_]+")
LEVEL, DICTIONARY_BYTES, SEGMENT = 3, 262_144, 64
#: Words in a window, and bytes of text in a sample of the training: samples are mixed, as the trainer takes segments from
#: each stretch of its input and stops where some stretches bring nothing new.
WINDOW, SAMPLE_BYTES = 3, 1024
#: Bytes saved by the toxic dictionary from which a window counts, one count for each.
SAVED = np.array([3, 6, 9, 12, 15, 18, 21, 24, 28, 32])


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]  # intercept; by SAVED: log of the share of such windows; log of their number


class Spelled(dict):
    """word -> its spelling."""

    def __init__(self):
        super().__init__()
        self.codes: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        marked, out = f"   {word} ", []
        for i in range(1, len(marked) - 2):
            gram = marked[i : i + 3]
            code = self.codes.get(gram)
            if code is None:
                code = self.codes[gram] = xxhash.xxh32_digest(gram.encode("utf-8", "surrogatepass"))
            out.append(code)
        got = self[word] = b"".join(out)
        return got


def _words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress


class Distances:
    """For each window of a text, its length under the ordinary dictionary less that under the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes, known_words: int = 300_000):
        self.toxic, self.ordinary, self.spelled, self.known_words = _compressor(toxic), _compressor(ordinary), Spelled(), known_words

    def __call__(self, text: str) -> np.ndarray:
        if len(self.spelled) > self.known_words:
            self.spelled = Spelled()
        own = list(map(self.spelled.__getitem__, _words(text)))
        toxic, ordinary = self.toxic, self.ordinary
        windows = [b"".join(own[k : k + WINDOW]) for k in range(0, len(own), WINDOW)]
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], np.int64)


def _trained(texts: list[str]) -> bytes:
    """A dictionary; where the texts are too few to train one, their own bytes."""
    spelled, samples = Spelled(), []
    for text in texts:
        own = b"".join(map(spelled.__getitem__, _words(text)))
        samples += [own[k : k + SAMPLE_BYTES] for k in range(0, len(own), SAMPLE_BYTES)]
    samples = [samples[int(k)] for k in np.random.default_rng(7).permutation(len(samples))]
    for size in (DICTIONARY_BYTES, DICTIONARY_BYTES // 4, DICTIONARY_BYTES // 32):
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8, f=20, accel=1, split_point=1.0).as_bytes()
        except zstandard.ZstdError:
            continue
    return b"".join(samples)[-DICTIONARY_BYTES:] or b" " * 8


def features(distances: list[np.ndarray]) -> np.ndarray:
    """A row for each text, in the order of Model.weights."""
    hits = np.array([(d[:, None] >= SAVED).sum(axis=0) for d in distances], float).reshape(-1, len(SAVED))
    n = np.array([[max(1, len(d))] for d in distances], float).reshape(-1, 1)
    return np.concatenate([np.ones((len(hits), 1)), np.log1p(1000 * hits / n), np.log1p(hits)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton's method; the intercept is hardly held back."""
    w, held = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    held[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (weight * (p - y)) + held * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(x: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 1600, longest: int = 20_000) -> Model:
    """A model from the documents of at most per_class ids of each label (the documented bound of the sample: those with
    the smallest hash of the id; of an id's texts of at most `longest` characters the smallest). The ids are chosen from
    the labels alone and, being so few, sent to the documents, so no text but theirs is shuffled. Two thirds of them train
    the dictionaries, as whole texts; the rest calibrate the counts of saved bytes, at the labels' true shares. Without
    rows of both labels, every score is the toxic share."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
    chosen = known.where("y = 0").orderBy(F.xxhash64(id_col), id_col).limit(per_class).union(known.where("y = 1").orderBy(F.xxhash64(id_col), id_col).limit(per_class))
    texts = documents.where(F.col(text_col).isNotNull() & (F.length(text_col) <= longest)).select(id_col, text_col)
    rows = texts.join(F.broadcast(chosen), id_col).groupBy(id_col, "y").agg(F.min(text_col).alias("t")).select("y", F.xxhash64(id_col), "t").collect()
    sample = {label: [t for y, _, t in sorted(rows) if y == label] for label in (0, 1)}
    learn = {y: [t for k, t in enumerate(s) if k % 3 != 2] for y, s in sample.items()}
    check = [(y, t) for y, s in sample.items() for k, t in enumerate(s) if k % 3 == 2]
    if not learn[0] or not learn[1] or {y for y, _ in check} != {0, 1}:
        return Model(b" " * 8, b" " * 8, (math.log(share / (1 - share)), *[0.0] * (2 * len(SAVED))))
    toxic, ordinary = _trained(learn[1]), _trained(learn[0])
    distances, y = Distances(toxic, ordinary), np.array([y for y, _ in check])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(toxic, ordinary, tuple(_logistic(features([distances(t) for _, t in check]), y, weight)))


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row and whole text, in one pass. Null texts count as empty, and those without a word have the
    score of no window; rows that repeat are scored each; an empty table gives no row; other columns are not read."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        distances = Distances(m.toxic, m.ordinary)

        def each(batch: pa.RecordBatch) -> dict:
            return {"id": batch["id"], "score": probability(features([distances(t) for t in batch["text"].to_pylist()]), m.weights)}

        return each

    kind = dict(documents.dtypes)[id_col]
    return by_batch(documents.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), f"id {kind}, score double", make).withColumnRenamed("id", id_col)


def op6_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, as scored() defines them; nothing is learned from labels
    of held-out ids."""
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = fit(documents, labels.where(~out))
    return scored(documents, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
