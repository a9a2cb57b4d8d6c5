"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

The join is that of prefix filtering. Tokens are ordered by their frequency over all documents, the rarest first. A
block that holds `contain` of a template's tokens must hold one of the template's first t - need + 1 tokens (prefix),
must have at least `need` tokens (length), and what is left behind the first common token must still suffice
(position). What passes is compared in full, so every block that meets the threshold is found, and no other.

Blocks are windows of consecutive words, whatever the line ends, so that a wrapped notice is found and words that are
scattered over a long line are not. Words that tell licenses apart (names, versions) can't be among those that lack.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, whole_text

#: Phrases whose words must stand one after the other, and their labels.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: Notices of public licenses, and their labels. A parameter: any number of (label, text) will do.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 'The software is provided "as is", without warranty of any kind, express or implied'),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

#: Words that a block must hold of a template that has them, as numbers always. A template with neither that has fewer
#: than SHORT distinct words must be held in full: what may lack of it could be its name.
NAMES = frozenset(b"mit apache gnu lesser mozilla creative commons nc".split())
SHORT = 8

#: Bytes that end a word become spaces, A-Z become small.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LINES = re.compile(rb"[\n\r]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


class Templates:
    """The templates' token sets in global order, with an index from prefix token to (template, place in its order)."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[bytes, int], contain: float, names: frozenset[bytes] | None = None):
        self.rank = {w: k for k, w in enumerate(sorted({w for _, t in templates for w in words_of(t.encode())}, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels = [label for label, _ in templates]
        self.sets = [sorted(self.rank[w] for w in set(words_of(t.encode()))) for _, t in templates]
        self.need = [max(1, math.ceil(contain * len(s) - 1e-9)) for s in self.sets]
        self.reach = [math.ceil(len(words_of(t.encode())) / contain - 1e-9) for _, t in templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (s, need) in enumerate(zip(self.sets, self.need, strict=True)):
            for place, token in enumerate(s[: len(s) - need + 1]):
                self.prefix.setdefault(token, []).append((k, place))
        by_rank = {v: k for k, v in self.rank.items()}
        self.must = [frozenset() for _ in self.sets]
        if names is not None:
            telling = [frozenset(token for token in s if by_rank[token] in names or by_rank[token].isdigit()) for s in self.sets]
            self.must = [m or frozenset(s if len(s) < SHORT else ()) for m, s in zip(telling, self.sets, strict=True)]
        self.prefix_words = {by_rank[token] for token in self.prefix}

    def within(self, block: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of the templates that the block meets."""
        distinct = set(block)
        tokens = sorted(self.rank[w] for w in distinct if w in self.rank)
        tried, out = set(), []
        for at, token in enumerate(tokens):
            for k, place in self.prefix.get(token, ()):
                if k in tried:
                    continue
                tried.add(k)
                s, need = self.sets[k], self.need[k]
                if len(distinct) < need or 1 + min(len(s) - place, len(tokens) - at) - 1 < need:
                    continue
                both = len(set(s).intersection(tokens))
                if both >= need:
                    out.append((k, both / len(s)))
        return out

    def windows(self, words: list[bytes]) -> list[tuple[int, int, int, float, bool]]:
        """(template, first word, end, containment, named) where `reach` consecutive words meet a template, cut to begin and
        end in words of it; named if its names and numbers are all there. From the left, a window that overlaps gives way
        to a named one, then to one that holds more, of equals the shorter. The text is walked once; a template's words are
        looked at only within reach of one of its prefix, without which no window meets it."""
        where: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            token = self.rank.get(word)
            if token is not None:
                where.setdefault(token, []).append(at)
        out = []
        for k, _ in self.within(words):  # a template that the whole text doesn't meet is met by no window
            own, need, reach = self.sets[k], self.need[k], self.reach[k]
            heads = sorted(at for token in own[: len(own) - need + 1] for at in where.get(token, ()))
            near = lambda at: (n := bisect_left(heads, at - reach + 1)) < len(heads) and heads[n] < at + reach  # noqa: B023, E731
            places = sorted((at, token) for token in own for at in where.get(token, ()) if near(at))
            held: Counter = Counter()
            first, best = 0, None
            for at, token in places:
                held[token] += 1
                while at - places[first][0] >= reach or held[places[first][1]] > 1:
                    held[places[first][1]] -= 1
                    if not held[places[first][1]]:
                        del held[places[first][1]]
                    first += 1
                if len(held) < need:
                    continue
                start = places[first][0]
                if best and start >= best[3]:
                    out.append((k, best[3] - best[2], best[3], -best[1] / len(own), not best[0]))
                    best = None
                found = (not self.must[k] <= held.keys(), -len(held), at + 1 - start, at + 1)
                best = min(best, found) if best else found
            if best:
                out.append((k, best[3] - best[2], best[3], -best[1] / len(own), not best[0]))
        return out


def token_frequency(documents: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many lines of all documents each word of the templates stands. The result has the templates' size."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            n: Counter = Counter()
            for text in batch["text"].to_pylist():
                raw = text.encode()
                if not vocabulary.isdisjoint(words_of(raw)):
                    for line in _LINES.split(raw):
                        n.update(vocabulary.intersection(words_of(line)))
            return {"word": list(n), "n": list(n.values())}

        return each

    counts = by_batch(documents.select(whole_text(text_col).alias("text")), "word binary, n long", make)
    return {bytes(r["word"]): r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contain: float = 0.8, id_col: str = "doc_id", text_col: str = "text", names: frozenset[bytes] = NAMES) -> DataFrame:
    """(id, n_words, phrases, blocks) of every row and whole text.

    phrases: array of (label, word), the word numbers from 0 at which a fixed phrase begins, overlaps included. blocks:
    array of (label, template, line, containment, named), the windows that hold at least `contain` of a template's distinct
    words, by the lines, from 0, where they begin; `named` says whether all of those that are names or numbers are among
    them, without which the label is a guess. A window has 1 / `contain` times the template's words; of windows that
    overlap one stays, a named one first, then the fullest, then the shortest. Null texts count as empty; rows that repeat
    are scanned each; an empty table gives no row; other columns are not read.
    """
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))
    index = Templates(templates, token_frequency(documents, vocabulary, text_col), contain, names)

    def make():
        phrases = [(p.split(), label) for p, label in PHRASES]

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("n_words", "phrases", "blocks")}
            for text in batch["text"].to_pylist():
                raw = text.encode()
                words = words_of(raw)
                found, blocks = [], []
                if b"license" in raw.lower():
                    for p, label in phrases:
                        at = -1
                        while True:
                            try:
                                at = words.index(p[0], at + 1)
                            except ValueError:
                                break
                            if words[at : at + len(p)] == p:
                                found.append({"label": label, "word": at})
                if not index.prefix_words.isdisjoint(words) and (met := index.windows(words)):
                    ends = list(accumulate(len(words_of(line)) for line in _LINES.split(raw)))
                    blocks = [{"label": index.labels[k], "template": k, "line": bisect_right(ends, a), "containment": c, "named": named} for k, a, _, c, named in met]
                out["n_words"].append(len(words))
                out["phrases"].append(found)
                out["blocks"].append(blocks)
            return {"id": batch["id"]} | out

        return each

    kind = dict(documents.dtypes)[id_col]
    schema = f"id {kind}, n_words long, phrases array<struct<label:string,word:long>>, blocks array<struct<label:string,template:int,line:long,containment:double,named:boolean>>"
    return by_batch(documents.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), schema, make).withColumnRenamed("id", id_col)


def op5_license_scan(documents: DataFrame) -> DataFrame:
    """score: 1 where a phrase stands, else the highest containment of a named block, 0 without one; labels of the method
    are those of named blocks; templates are the numbers of all that have a block at the threshold, named or not."""
    joined = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    found = scan(documents).withColumn("sure", F.filter("blocks", lambda b: b["named"]))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min("phrases.word").alias("first_word"), F.array_max("phrases.word").alias("last_word"),
        joined("phrases.label").alias("base_labels"), joined("phrases.label", "sure.label").alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("sure.containment"), F.lit(0.0))).alias("score"), F.array_join(F.array_sort(F.array_distinct("blocks.template")), ",").alias("templates"),
    )


def _oracle(contain: float = 0.8) -> str:
    """Every window of a template's reach that begins with one of its words, by the words that they share, without the
    filters."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    index = Templates(TEMPLATES, {}, contain, NAMES)
    by_rank = {v: k.decode() for k, v in index.rank.items()}
    rows = ", ".join(f"({k}, '{index.labels[k]}', '{by_rank[w]}', {w in index.must[k]}, {len(index.must[k])}, {len(s)}, {index.need[k]}, {index.reach[k]})" for k, s in enumerate(index.sets) for w in s)
    words = lambda x: f"regexp_extract_all(translate({x}, '{up}', '{low}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    places = ", ".join("list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {n}] = '{x.decode()}'" for n, x in enumerate(p.split())) + f") AS p{k}" for k, (p, _) in enumerate(PHRASES))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    own = "list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES)) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH t(k, label, word, must, n_must, size, need, reach) AS (VALUES {rows}),
d AS MATERIALIZED (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents), p AS (SELECT doc_id, w, {places} FROM d), b AS (SELECT doc_id, len(w) AS n_words, {every} AS places, {own} AS own FROM p),
x AS MATERIALIZED (SELECT doc_id, at_word, t.* FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at_word FROM d) JOIN t USING (word)),
y AS MATERIALIZED (SELECT * FROM x QUALIFY len(list_distinct(list(word) OVER (PARTITION BY doc_id, k))) >= need),
m AS (SELECT u.doc_id, u.k, u.at_word, any_value(u.label) AS label, count(DISTINCT v.word) AS n, any_value(u.size) AS size, count(DISTINCT v.word) FILTER (v.must) = any_value(u.n_must) AS named FROM y u JOIN y v ON v.doc_id = u.doc_id AND v.k = u.k AND v.at_word BETWEEN u.at_word AND u.at_word + u.reach - 1 GROUP BY u.doc_id, u.k, u.at_word HAVING count(DISTINCT v.word) >= any_value(u.need)),
g AS (SELECT doc_id, list(DISTINCT label) FILTER (named) AS labels, max(n::DOUBLE / size) FILTER (named) AS c, array_to_string(list_sort(list(DISTINCT k)), ',') AS templates FROM m GROUP BY doc_id)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(list_sort(own), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(own || coalesce(labels, []))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1 ELSE coalesce(c, 0) END::DOUBLE AS score, coalesce(templates, '') AS templates FROM b LEFT JOIN g USING (doc_id)"""


ORACLE = _oracle()
