"""Language identification by word-first backoff: known words by their log frequency in each language, unseen words by
the longest character n-grams that are known."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_batch, checked_broadcast, lowest_share, written

WORDS = re.compile(r"[^\W\d_]+")
NONE = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: word, and n-gram (with ^ and $ at word ends), -> row of the table of log frequencies, a column a language
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    longest: int


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _log_frequencies(counts: DataFrame, key: str, languages: list[str], least: int) -> tuple[list[str], np.ndarray]:
    """Smoothed log frequency of every key seen at least `least` times. The rows that come to the driver are bounded
    by the size of the labelled sample."""
    wide = counts.groupBy(key).agg(*[F.sum(F.when(F.col("lang") == name, F.col("c")).otherwise(0)).alias(f"c{k}") for k, name in enumerate(languages)])
    rows = wide.where(sum((F.col(f"c{k}") for k in range(len(languages))), F.lit(0)) >= least).toPandas()
    n = rows[[f"c{k}" for k in range(len(languages))]].to_numpy(float)
    logs = np.log((n + 0.05) / (n.sum(0) + 0.05 * max(1, len(n)))) if len(n) else n
    return list(rows[key]), logs.astype(np.float32)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, longest: int = 5, least: int = 2, most_chars: int = 50_000) -> Model:
    """A model from at most `per_language` labelled ids of each language (the documented bound of the sample: those with
    the smallest hash of the id, texts of over `most_chars` characters passed over). Null or empty languages are not
    learned. The rows of each language are counted first, and only ids of so low a hash that about twice as many as are
    wanted have it are ranked, so no task ranks a language."""
    order = Window.partitionBy("lang").orderBy("h", "id")
    rows = labelled.where(f"{lang_col} is not null and {lang_col} <> '' and {text_col} is not null and {id_col} is not null").where(F.length(text_col) <= most_chars)
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Model([], {}, {}, np.zeros((0, 0), np.float32), longest)
    total = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(totals.items()) for x in kv]), F.col("lang"))
    low = rows.select("lang", "id", F.xxhash64("id").alias("h")).where(lowest_share(F.col("h"), per_language, total)).distinct()
    chosen = written(low.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("lang", "id"), "chosen")
    sample = rows.join(checked_broadcast(chosen, 64), ["lang", "id"])  # per_language ids a language: no text is shuffled

    def count():
        def each(batch: pa.RecordBatch) -> dict:
            lang, word = [], []
            for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = WORDS.findall(text.lower())
                lang += [name] * len(found)
                word += found
            return {"lang": lang, "word": word}

        return each

    words = written(by_batch(sample.select("lang", "text"), "lang string, word string", count).groupBy("lang", "word").agg(F.count("*").alias("c")), "words")
    languages = sorted(totals)
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = words.select("lang", "c", marked.alias("w"), F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n")).where(F.col("n") <= F.length("w"))
    grams = grams.select("lang", "c", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("n") + 1), lambda i: F.substring("w", i, F.col("n")))).alias("gram"))
    grams = grams.groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    (w, w_table), (g, g_table) = _log_frequencies(words, "word", languages, least), _log_frequencies(grams, "gram", languages, 4 * least)
    table = np.concatenate([w_table, g_table])
    return Model(languages, {x: k for k, x in enumerate(w)}, {x: k + len(w) for k, x in enumerate(g)}, table, longest)


class _Scores(dict):
    """word -> row of the score table: the model's words, then unseen ones as they come, which back off to shorter and
    shorter n-grams. `rows` holds the rows that the table lacks."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model, self.rows, self.next = model, [], len(model.table)

    def __missing__(self, word: str) -> int:
        m, row, marked = self.model, None, f"^{word}$"
        for n in range(min(m.longest, len(marked)), 0, -1):
            known = [g for i in range(len(marked) - n + 1) if (g := m.grams.get(marked[i : i + n])) is not None]
            if known:
                row = m.table[known].mean(axis=0)
                break
        self.rows.append(np.zeros(len(m.languages), np.float32) if row is None else row)
        self[word] = self.next
        self.next += 1
        return self.next - 1


def predict(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), known_words: int = 150_000) -> DataFrame:
    """(id, kept, lang_pred, score) for every row and whole text. Null texts and texts without letters get `und` and
    score 0; so does everything if the model has learned no language. Ties go to the first language by name. The score
    is the winner's share after each language's mean log frequency is spread over ten words. `kept` is a struct of the
    columns named by keep, left out where none are. Rows that repeat are predicted each; an empty table gives no row;
    columns that are not named are not read."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kinds = dict(documents.select(F.col(id_col).alias("id"), F.struct(*dict.fromkeys((text_col, *keep))).alias("kept")).dtypes)
    columns = ["id", "kept"] if keep else ["id"]

    def make():
        scores = _Scores(sent.value)
        languages = np.array([*sent.value.languages, NONE], dtype=object)
        matrix = sent.value.table

        def some(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal scores, matrix
            if scores.next - len(sent.value.table) > known_words:  # only a memory bound: rows are made again as words come
                scores, matrix = _Scores(sent.value), sent.value.table
            flat, sizes = [], []
            for text in texts:
                found = WORDS.findall((text or "").lower())
                if not matrix.shape[1] or not any(c.isalpha() for w in found for c in w):
                    found = []  # nothing is learned, or there is no letter
                flat += found
                sizes.append(len(found))
            ids = np.fromiter(map(scores.__getitem__, flat), np.int64, len(flat))
            if scores.rows:
                matrix = np.concatenate([matrix, np.array(scores.rows, np.float32).reshape(-1, matrix.shape[1])])
                scores.rows.clear()
            n, best, share = np.array(sizes), np.full(len(sizes), len(languages) - 1), np.zeros(len(sizes))
            full = np.flatnonzero(n)
            if len(full) and matrix.shape[1]:
                starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                mean = np.add.reduceat(matrix[ids], starts, axis=0, dtype=float) / n[full][:, None]
                soft = np.exp(10 * (mean - mean.max(1, keepdims=True)))
                best[full], share[full] = mean.argmax(1), soft.max(1) / soft.sum(1)
            return best, share

        def each(batch: pa.RecordBatch) -> dict:
            texts = batch["kept"].field(0).to_pylist()
            best, share = (np.concatenate(x) for x in zip(*[some(texts[k : k + 64]) for k in range(0, len(texts), 64)], strict=True))
            return {c: batch[c] for c in columns} | {"lang_pred": languages[best], "score": share}

        return each

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", lang_pred string, score double"
    return by_batch(documents.select(F.col(id_col).alias("id"), F.struct(*dict.fromkeys((text_col, *keep))).alias("kept")), schema, make).withColumnRenamed("id", id_col)


def learned_from(documents: DataFrame) -> Model:
    return fit(documents.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))


def op7_language_id(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, as predict() defines them; held-out rows teach nothing."""
    found = predict(documents, learned_from(documents))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
