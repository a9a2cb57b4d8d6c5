"""Fuzzy dictionary match: words that are nearly a known name, by the strings that deletions leave of both. Two words within
k edits have one such string in common, so they meet by an equal join; only what meets is measured. Nothing is compared
with every name."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .anchors import numbered_literals, with_hits
from .turns import rewrite_required

#: Shorter words are never fuzzy; longer ones neither, as the number of their deletions grows too fast.
SHORTEST, LONGEST = 4, 20
#: The least share of letters in common blocks of a name, and how sure each kind of change is.
LEAST_RATIO, SURE_WORD, SURE_ALIAS, SURE_FUZZY, SURE_REWRITE = 0.86, 0.95, 0.96, 0.9, 0.92
TOKEN = "[A-Za-z][A-Za-z0-9]*|[^A-Za-z]+"


def edits_of(n: Column) -> Column:
    """Edits allowed between two words whose shorter one has n letters."""
    return F.when(n < 8, 1).otherwise(2)


def deletions_of(n: Column, ratio: float | None = None) -> Column:
    """How many letters may have to go from a word of n letters: the edits allowed, or what a ratio of common letters
    leaves, whatever the length of the other word."""
    return edits_of(n) if ratio is None else F.floor(n * (2 * (1 - ratio) / (2 - ratio)) + 1e-9).cast("int")


def deletions(word: Column, k: Column, most: int) -> Column:
    """The distinct strings that are left of a word by deleting up to k letters, k being `most` at most."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = level = F.array(word)
    for n in range(1, most + 1):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda w: F.length(w) > 0), once)))
        out = F.when(k >= n, F.concat(out, level)).otherwise(out)
    return F.array_distinct(out)


def _keyed(words: DataFrame, column: str, ratio: float | None) -> DataFrame:
    """(column, key) of the distinct words of a length that may be fuzzy. Words are cut by how many deletions they need,
    so a short word is spared the strings of a long one."""
    rows = words.select(F.lower(column).alias(column)).where(F.length(column).between(SHORTEST, LONGEST)).distinct().withColumn("k", deletions_of(F.length(column), ratio))
    most = 2 if ratio is None else int(LONGEST * 2 * (1 - ratio) / (2 - ratio) + 1e-9)
    keys = F.lit(None)
    for n in range(most + 1):
        keys = F.when(F.col("k") == n, deletions(F.col(column), F.lit(n), n)).otherwise(keys)
    return rows.select(column, F.explode(keys).alias("key"))


def pairs(words: DataFrame, names: DataFrame, ratio: float | None = None) -> DataFrame:
    """(word, name, distance, score) of words (word) and names (name), both in small letters, that are near and not equal.
    Without a ratio, near is within the edits allowed, and the score is 1 less edits by length of the longer; with one, the
    score is twice the letters in common blocks by the letters of both, and must reach it."""
    met = _keyed(words, "word", ratio).join(_keyed(names, "name", ratio), "key").where("word <> name").select("word", "name").distinct()
    met = met.withColumn("distance", F.levenshtein("word", "name"))
    if ratio is None:
        near = met.where(F.col("distance") <= edits_of(F.least(F.length("word"), F.length("name"))))
        return near.withColumn("score", 1 - F.col("distance") / F.greatest(F.length("word"), F.length("name")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [SequenceMatcher(None, w, n).ratio() for w, n in zip(batch["word"].to_pylist(), batch["name"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    return met.mapInArrow(run, "word string, name string, distance int, score double").where(F.col("score") >= ratio)


def best_names(found: DataFrame, names: DataFrame) -> DataFrame:
    """(word, name, score): of each word's near names the best, of equal ones the first by `place` of names (name, place).
    Words that are names have none."""
    placed = found.join(names.select(F.lower("name").alias("name"), "place").groupBy("name").agg(F.min("place").alias("place")), "name")
    return placed.groupBy("word").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), "place", "name")).alias("b")).select("word", "b.*").join(names.select(F.lower("name").alias("word")).distinct(), "word", "left_anti")


def named(messages: DataFrame, names: DataFrame, text_col: str = "text") -> DataFrame:
    """messages with `named`, the first name by place of names (name, place) that the text holds in any case; null without
    one. One automaton of all names reads each text once."""
    known = names.groupBy(F.lower("name").alias("literal")).agg(F.min(F.struct("place", "name")).alias("first"))
    literals = numbered_literals(known)
    hay = messages.withColumn("_hay", F.lower(tx.filled(F.col(text_col))))
    found = with_hits(hay, "_hay", literals).drop("_hay").withColumn("_row", F.monotonically_increasing_id())
    places = known.select(F.xxhash64("literal").alias("_lid"), "first")
    hits = found.select("_row", F.explode("hits").alias("_lid")).join(places, "_lid").groupBy("_row").agg(F.min("first")["name"].alias("named"))
    return found.drop("hits").join(hits, "_row", "left").drop("_row")


def rewritten(text: Column, product: Column) -> Column:
    """A message whose words for the product are its name: `its x` is `the x of` it, once; `the product`, `it`, `this` and
    `that` are it."""
    name = F.regexp_replace(product, r"([\\$])", r"\\$1")
    out = F.regexp_replace(F.trim(text), F.lit(r"(?is)^(.*?)\bits\s+((?-s:.+?))(\?|$)"), F.concat(F.lit("$1the $2 of "), name, F.lit("$3")))
    for word in ("the product", "it", "this", "that"):
        out = F.regexp_replace(out, F.lit(rf"(?i)\b{word}\b"), name)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def bound(text: Column, product: Column) -> Column:
    """A message about an attribute with the product it is of."""
    return F.concat(F.regexp_replace(text, r"[ ?.!]+$", ""), F.lit(" of "), product, F.lit("?"))


def routed(messages: DataFrame, names: DataFrame, fixes: DataFrame, ratio: float | None = LEAST_RATIO) -> DataFrame:
    """(message_id, rewritten, confidence, entities) of messages (message_id, text, product).

    Words are put right by fixes (word, replacement, sure), then by the near names of those that are no name, then the
    product of the conversation is put where a message leans on it (see turns.rewrite_required). The confidence is that of
    the least sure change, entities the distinct names put in or named. Null texts are empty; telephone-like messages stay
    as they are. Only distinct words meet names; a message's words meet their corrections by an equal join."""
    kept = messages.select("message_id", F.trim(tx.filled(F.col("text"))).alias("text"), F.coalesce("product", F.lit("")).alias("product")).withColumn("still", F.col("text").rlike(r"^\+?\d[\d\s\-()]{6,}\d$"))
    words = kept.where("not still").select("message_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("at", "token")).withColumn("word", F.lower("token"))
    fix = fixes.groupBy(F.lower("word").alias("word")).agg(F.min(F.struct("replacement", "sure", F.coalesce("is_name", F.lit(False)).alias("is_name"))).alias("fix"))
    vocabulary = words.where(F.col("token").rlike("^[A-Za-z]")).select("word").distinct().join(fix, "word", "left_anti")
    single = names.where(F.length(F.split("name", " ")[0]) >= SHORTEST).select(F.split("name", " ")[0].alias("name"), "place")
    near = best_names(pairs(vocabulary, single, ratio), names.unionByName(single))
    cased = single.groupBy(F.lower("name").alias("name")).agg(F.min_by("name", "place").alias("cased"))
    near = near.join(cased, "name").select("word", F.struct(F.col("cased").alias("replacement"), F.lit(SURE_FUZZY).alias("sure"), F.lit(True).alias("is_name")).alias("fix"))
    put = words.join(fix.union(near), "word", "left")
    one = F.struct("at", F.coalesce("fix.replacement", "token").alias("token"))
    back = put.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["token"]), "").alias("put"), F.min("fix.sure").alias("sure"), F.array_sort(F.collect_set(F.when(F.col("fix.is_name"), F.col("fix.replacement")))).alias("found"))
    rows = named(kept.join(back, "message_id", "left").withColumn("put", F.coalesce("put", "text")), names, "put")
    product, leans = F.col("product"), rewrite_required(F.col("put"), F.col("product"), F.col("named"))
    points = F.col("put").rlike(r"(?i)\b(it|its|this|that|the product)\b")
    final = F.when(leans & points, rewritten(F.col("put"), product)).when(leans, bound(F.col("put"), product)).otherwise(F.col("put"))
    final = F.when(F.col("still"), F.col("text")).otherwise(F.trim(F.regexp_replace(final, r"\s+", " ")))
    entities = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array("named", F.when(leans, product))), lambda x: x.isNotNull())))
    out = rows.select("message_id", "text", final.alias("rewritten"), F.least(F.coalesce("sure", F.lit(1.0)), F.when(leans, SURE_REWRITE).otherwise(1.0)).alias("sure"), F.when(F.col("still"), F.array().cast("array<string>")).otherwise(entities).alias("entities"))
    return out.select("message_id", "rewritten", F.when(F.col("rewritten") == F.col("text"), 1.0).otherwise(F.col("sure")).alias("confidence"), "entities")

