"""Phrase collocation mining by an FM-index for each shard of word ids.

A task gathers the words of its documents by language into shards. Over a shard, the BWT of its word ids and that of the
reversed ids are built; from the whole interval on, every interval of a phrase is extended to the left by all of its words
at once, and its interval of the reversed index is kept in step, so that the words before and after each phrase are
read from the two BWTs. Phrases are enumerated to a fixed depth with their counts; the counts are summed over shards.

Most phrases are too rare to be candidates, but no shard knows which. A first pass counts hashes of phrases in a table of
fixed size; a phrase in a slot whose sum is too small can't be frequent, so its interval isn't extended nor emitted. Slots
that phrases share only let more through, so the result is exact whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, bounded_batches, checked_broadcast, written

#: Words of a shard. A text is never cut, so a shard holds at most so many and one text more.
SHARD_WORDS = 2_000_000
#: Phrases in a batch that leaves a task.
ROWS_OUT = 50_000
#: Characters that end a piece; what stands between them is cut at spaces and tabs.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
FOLD = bytes.maketrans(BREAKS + bytes(range(65, 91)), b"\n" * len(BREAKS) + bytes(range(97, 123)))
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Params:
    #: The longest phrase, and the fewest occurrences of a candidate.
    words: int = 3
    least: int = 10
    #: A candidate goes if a longer one that holds it has at least this percentage of its occurrences.
    percent: int = 50
    #: Phrases returned of each language.
    top: int = 2000
    #: The first pass has 2 ** slots slots: a byte each in a task, a bit each in what is sent to the tasks.
    slots: int = 26


class Ids(dict):
    """word -> its number in the shard, from 1; a break is 0."""

    def __init__(self):
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_ids(text: str, ids: Ids) -> np.ndarray:
    """The ids of a text's words, with a break before each piece and one at the end."""
    words = text.encode().translate(FOLD).replace(b"\n", b" . ").split()
    out = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
    own = np.concatenate([np.zeros(1, np.int32), out, np.zeros(1, np.int32)])
    return own[np.concatenate([[True], (own[1:] > 0) | (own[:-1] > 0)])]


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Places of a circular sequence, ordered by the `depth` symbols from each on. It is what the intervals of phrases of
    up to so many words need. Several symbols are packed into one key; where they don't fit, ranks of them are packed
    again, each for twice as many symbols or more."""
    rank, span = t.astype(np.int64), 1
    while True:
        bits = max(1, int(rank.max()).bit_length())
        each = min(-(-depth // span), 63 // bits)
        key = rank.copy()
        for k in range(1, each):
            key = (key << bits) | np.roll(rank, -k * span)
        order = np.argsort(key, kind="stable")
        span *= each
        if span >= depth:
            return order
        own = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])


class Bwt:
    """last: the symbol before each place, in suffix order. first: the sorted symbols. step: where each place's rotation
    lands when it is extended by its last symbol, the number of smaller symbols and of equal ones before it."""

    def __init__(self, t: np.ndarray, depth: int):
        self.last = np.roll(t, 1)[suffix_order(t, depth)]
        order = np.argsort(self.last, kind="stable")
        self.first = self.last[order]
        self.step = np.empty(len(t), np.int64)
        self.step[order] = np.arange(len(t))
        self.words_before = np.concatenate([[0], np.cumsum(self.last > 0)])


@dataclass
class Phrases:
    """The distinct phrases of one length: first word, the phrase that follows it (a row of the level before), number of
    occurrences, and how many of these have a word before and after them in their piece."""

    word: np.ndarray
    rest: np.ndarray
    count: np.ndarray
    left: np.ndarray
    right: np.ndarray


class Slots:
    """Hashes of phrases: that of a word and the phrase behind it is made of theirs."""

    def __init__(self, lang: str, ids: Ids, bits: int):
        own = xxhash.xxh3_64_intdigest(lang.encode())
        self.words = np.array([xxhash.xxh3_64_intdigest(w, own) for w in ids], np.uint64)
        self.shift = np.uint64(64 - bits)

    def joined(self, word: np.ndarray, rest: np.ndarray | None) -> np.ndarray:
        h = self.words[word]
        if rest is not None:
            h = (h ^ (rest * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(31)
        return h

    def of(self, h: np.ndarray) -> np.ndarray:
        return (h >> self.shift).astype(np.int64)


def phrases(t: np.ndarray, depth: int, slots: Slots | None = None, frequent: np.ndarray | None = None) -> Iterator[Phrases]:
    """The phrases of 1 to `depth` words of a sequence of ids in which 0 is a break, level by level. Phrases of two words or
    more whose slot is not set in the bits `frequent` are left out, as are those that end in one."""
    index, back = Bwt(t, depth), Bwt(t[::-1], depth)
    hashes = None
    label = np.zeros(len(t), np.int64)  # the interval of the level that each place is in, or -1
    r_start = np.zeros(1, np.int64)  # the start of each interval's reversed phrase in the other index
    for level in range(depth):
        rest = np.empty_like(label)
        rest[index.step] = label  # every interval extended by every symbol before it
        live = (index.first > 0) & (rest >= 0)
        new = live & np.concatenate([[True], (index.first[1:] != index.first[:-1]) | (rest[1:] != rest[:-1])])
        start = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        count = np.bincount(run[live], minlength=len(start)).astype(np.int64)
        word, parent = index.first[start], rest[start]
        if slots:
            hashes = slots.joined(word, None if hashes is None else hashes[parent])
        breaks = np.bincount(label[(label >= 0) & (index.last == 0)], minlength=len(r_start))
        order = np.lexsort((word, parent))  # in the reversed index, an interval's extensions follow each other by symbol
        before = np.cumsum(count[order]) - count[order]
        lead = np.concatenate([[True], parent[order][1:] != parent[order][:-1]]) if len(order) else np.zeros(0, bool)
        before -= before[lead][np.cumsum(lead) - 1] if len(order) else 0
        begin = np.empty_like(start)
        begin[order] = r_start[parent[order]] + breaks[parent[order]] + before
        left = index.words_before[start + count] - index.words_before[start]
        right = back.words_before[begin + count] - back.words_before[begin]
        kept = np.arange(len(start))
        if slots and level:
            at = slots.of(hashes)
            kept = np.flatnonzero(frequent[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
            hashes = hashes[kept]
        yield Phrases(word[kept], parent[kept], count[kept], left[kept], right[kept])
        place = np.full(len(start) + 1, -1, np.int64)
        place[kept] = np.arange(len(kept))
        label, r_start = place[np.where(live, run, len(start))], begin[kept]


def _mined(lang: str, ids: Ids, parts: list[np.ndarray], p: Params, frequent: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a shard: the empty phrase with the number of words, and the phrases that may be frequent."""
    t = np.concatenate(parts)
    names = pa.array(list(ids), pa.binary()).cast(pa.string())

    def rows(phrase: pa.Array, *numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(phrase), ROWS_OUT):
            own = phrase[k : k + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, *[pa.array(n[k : k + ROWS_OUT], pa.int64()) for n in numbers]], schema=schema)

    none = np.zeros(1, np.int64)
    yield from rows(pa.array([""]), np.array([np.count_nonzero(t)]), none, none)
    before = None
    for level in phrases(t, p.words, Slots(lang, ids, p.slots), frequent):
        word = names.take(pa.array(level.word))
        before = word if before is None else pc.binary_join_element_wise(word, before.take(pa.array(level.rest)), " ")
        yield from rows(before, level.count, level.left, level.right)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Ids, list[np.ndarray]]]:
    """A task's texts as shards of one language each. Once they hold SHARD_WORDS words together, the largest goes."""
    shards: dict[str, tuple[Ids, list[np.ndarray]]] = {}
    held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids, parts = shards.setdefault(lang, (Ids(), []))
            parts.append(word_ids(text, ids))
            held[lang] = held.get(lang, 0) + len(parts[-1])
            if sum(held.values()) >= SHARD_WORDS:
                lang = max(held, key=held.__getitem__)
                held.pop(lang)
                yield lang, *shards.pop(lang)
    while shards:
        lang = next(iter(shards))
        yield lang, *shards.pop(lang)


def _may_be_frequent(texts: DataFrame, p: Params) -> np.ndarray:
    """A bit for each slot: whether the phrases of two words or more in it occur p.least times together. A task counts in
    one byte a slot, up to p.least, as no more matters for the sum; what leaves it are blocks of slots, which are summed
    by block. The driver sees the bits alone."""
    size, most = min(1 << p.slots, 1 << 16), min(255, p.least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << p.slots, np.uint8)
        for lang, ids, parts in _shards(batches):
            t, slots = np.concatenate(parts), Slots(lang, ids, p.slots)
            inside, h, found = t > 0, slots.joined(t, None), []
            for _ in range(p.words - 1):
                inside = inside[:-1] & (t[: len(inside) - 1] > 0) & inside[1:]
                h = slots.joined(t[: len(h) - 1], h[1:])
                found.append(slots.of(h[inside]))
            own, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            table[own] = np.minimum(table[own] + n, most)
        blocks = table.reshape(-1, size)
        for k in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blocks[k].tobytes()], pa.binary())], names=["block", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.zeros(size, np.int64)
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(held >= p.least).tobytes()], pa.binary())], names=["block", "n"])
        for batch in batches:
            for block, n in zip(batch["block"].to_pylist(), batch["n"].to_pylist(), strict=True):
                if block != at:
                    if at is not None:
                        yield bits()
                    at, held = block, np.zeros(size, np.int64)
                held += np.frombuffer(n, np.uint8)
        if at is not None:
            yield bits()

    sums = texts.mapInArrow(count, "block int, n binary").repartition("block").sortWithinPartitions("block").mapInArrow(total, "block int, n binary")
    out = np.zeros((1 << p.slots) // 8, np.uint8) if p.least > 0 else np.full((1 << p.slots) // 8, 255, np.uint8)
    for r in sums.collect():
        out[r["block"] * size // 8 : (r["block"] + 1) * size // 8] = np.frombuffer(r["n"], np.uint8)
    return out


def phrase_counts(documents: DataFrame, p: Params = Params(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, a, left_words, right_words): for each language the phrases of up to p.words words that occur p.least
    times or more (255 at most), their occurrences, and how many of these have a word before and after them in their piece;
    the empty phrase has the number of all words. Null languages are `und`; null texts are empty; repeated rows count
    each; an empty table gives no row. A shard emits a phrase once, so no key is hot. The result is a written table."""
    spark, ddl = documents.sparkSession, "lang string, phrase string, a long, left_words long, right_words long"
    arrow = arrow_schema(spark, ddl)
    bounded_batches(spark)
    texts = documents.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = spark.sparkContext.broadcast(_may_be_frequent(texts, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, parts in _shards(batches):
            yield from _mined(lang, ids, parts, p, frequent.value, arrow)

    sums = texts.mapInArrow(run, ddl).groupBy("lang", "phrase").agg(*[F.sum(c).alias(c) for c in ("a", "left_words", "right_words")])
    return written(sums.where((F.col("a") >= p.least) | (F.col("phrase") == "")), "phrases")


def collocations(counts: DataFrame, p: Params = Params()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, left_words, right_words): of the phrases of two words or more, those that
    no longer one holds with p.percent of their occurrences, the first p.top of each language by score, occurrences and
    phrase. The score is floor(10^6 a^2 / (l r)) of the cut into two parts where it is lowest (of equal ones the first),
    with l and r the parts' occurrences; all in 38 digits. `counts` is what phrase_counts() gives."""
    size = F.size(F.split("phrase", " "))
    sized = counts.where("phrase <> ''").withColumn("m", size)
    candidates = sized.where("m >= 2")
    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("last", F.expr("substring(phrase, length(first) + 2)"))
    parts = sized.where(F.col("m") < p.words).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    cut = cut.join(parts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("part").alias("last"), F.col("f").alias("r")), ["lang", "last"])
    score = F.expr(f"(cast(1000000 as {WIDE}) * cast(a as {WIDE}) * cast(a as {WIDE})) div (cast(l as {WIDE}) * cast(r as {WIDE}))")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, m - 1), w -> transform(sequence(0, m - w), i -> array_join(slice(split(phrase, ' '), i + 1, w), ' '))))")
    longer = sized.where("m >= 3").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("within").cast(WIDE) < p.percent * F.col("a").cast(WIDE), F.lit(True)))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= p.top)
    n = checked_broadcast(counts.where("phrase = ''").select("lang", F.col("a").alias("n")), 64)
    around = counts.select("lang", "phrase", "left_words", "right_words")
    full = ranked.join(n, "lang").join(around, ["lang", "phrase"])
    return full.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), "left_words", "right_words")


def op12_collocations(documents: DataFrame, p: Params = Params()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the 2,000 best phrases of two or three words of each language, as
    phrase_counts() and collocations() define them; other columns are not read."""
    return collocations(phrase_counts(documents, p), p).drop("left_words", "right_words")


ORACLE = """
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), piece AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t
), w AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM piece
), gram AS (
  SELECT lang, m, unnest(list_transform(generate_series(1, len(ws) - m + 1), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(m) WHERE len(ws) >= m
), f AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS c FROM gram GROUP BY ALL
), n AS (
  SELECT lang, sum(c)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, m, phrase, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND c >= 10
), parts AS MATERIALIZED (
  SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM c, (VALUES (1), (2)) s(k) WHERE k < m
), few AS MATERIALIZED (
  SELECT lang, phrase, c FROM f WHERE c >= 10
), cut AS (
  SELECT p.lang, p.phrase, p.m, p.a, p.k, u.c AS l, v.c AS r, (1000000::HUGEINT * p.a * p.a) // (u.c::HUGEINT * v.c) AS score
  FROM parts p JOIN few u ON u.lang = p.lang AND u.phrase = p.x JOIN few v ON v.lang = p.lang AND v.phrase = p.y
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS most FROM c, (VALUES (1), (2)) s(i) WHERE m = 3 GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase AND b.m = 2 WHERE g.most IS NULL OR 100 * g.most < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
