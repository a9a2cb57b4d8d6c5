"""Token-id output: shards of raw id payloads in ascending key order, each with a minimal perfect hash index that leads
from a document key to its place, checked by a stored fingerprint.

The file format is a Parquet table, one row a shard, so that every store that Spark reaches can hold it:

    shard     long    rises with the keys
    n_ids     long    ids in the payload
    low, high long    first and last key (null: the shard has null keys only)
    keys      binary  keys of its documents, ascending, 64-bit; documents with a null key come first and aren't listed
    starts    binary  place of each document's first id in the payload, and the payload's length, 64-bit
    sizes     binary  slots of each level of the hash, 64-bit
    bits      binary  their occupied slots, in 64-bit words
    ranks     binary  occupied slots before each word, 32-bit
    rows      binary  by hash value: the first document with the key, 32-bit
    prints    binary  by hash value: the key's fingerprint, 32-bit
    payload   binary  ids, unsigned 16-bit if the vocabulary allows, else 32-bit
    width     int     bytes of an id

All numbers are little-endian.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, bounded_batches, by_batch, checked_broadcast, fresh_path, whole_text, written

SHARD_IDS = 1 << 21
#: About the bytes of two shards: so few share a row group that a lookup passes over the others.
SHARD_BYTES = 16 << 20
#: A chunk of text that always gives the one token that no other text gives; it separates chunks in one call.
MARK = "½"
#: What a text must not hold if small letters are to be all that the tokenizer's normalisation does: letters beyond the
#: Latin blocks, where marks combine, and white space other than spaces and line ends.
BEYOND = re.compile("[^\x00-\u024f]|[\x09\x0b-\x0d\x1c-\x1f\x85\xa0]")
ODD_SPACES = "\x09\x0b\x0c\x0d\x1c\x1d\x1e\x1f"
SCHEMA = "shard long, n_ids long, low long, high long, keys binary, starts binary, sizes binary, bits binary, ranks binary, rows binary, prints binary, payload binary, width int"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints_of(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000_003) >> np.uint64(32)).astype("<u4")


class PerfectHash:
    """Level by level, a key that is alone in its slot stays there and the others go on; a key's value is the number of
    occupied slots before its own. Distinct keys get the values 0 to n - 1. A lookup reads one word of each level it
    passes, two on average."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.sizes, self.bits, self.ranks = sizes, bits, ranks
        self.first = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)  # word at which each level begins

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], np.ascontiguousarray(keys, np.int64)
        while len(left):
            size = 64 * (len(left) * 3 // 128 + 1)
            slot = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[slot]]
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]) if len(bits) else np.zeros(0)
        return PerfectHash(np.array(sizes, "<i8"), bits, ranks.astype("<u4"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; for keys that aren't in the set, that of some other key, or -1."""
        keys = np.ascontiguousarray(keys, np.int64)
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            slot = (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.first[level] + (slot >> 6), (slot & 63).astype(np.uint64)
            there = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[there], bit[there]
            out[open_[there]] = self.ranks[w] + np.bitwise_count(self.bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            open_ = open_[~there]
        return out


class Shard:
    """A shard as read."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.keys, self.starts, self.rows, self.prints = get("keys", "<i8"), get("starts", "<i8"), get("rows", "<u4"), get("prints", "<u4")
        self.hash = PerfectHash(get("sizes", "<i8"), get("bits", "<u8"), get("ranks", "<u4"))
        self.payload, self.width = row["payload"], row["width"]
        self.nulls = len(self.starts) - 1 - len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first document of each key, -1 where the fingerprint or the key says that it isn't here."""
        if not len(self.rows):
            return np.full(len(keys), -1)
        value = self.hash(keys)
        row = self.rows[value].astype(np.int64)
        good = (value >= 0) & (self.prints[value] == prints_of(keys))
        good[good] = self.keys[row[good] - self.nulls] == keys[good]
        return np.where(good, row, -1)

    def ids(self, document: int) -> np.ndarray:
        a, b = int(self.starts[document]), int(self.starts[document + 1])
        return np.frombuffer(self.payload, f"<u{self.width}", b - a, a * self.width)


def _shard(number: int, keys: list[int | None], parts: list[bytes], width: int) -> dict:
    starts = np.concatenate([[0], np.cumsum([len(p) // width for p in parts])]).astype("<i8")
    own = np.array([k for k in keys if k is not None], "<i8")
    nulls = len(keys) - len(own)
    distinct, first = np.unique(own, return_index=True)
    hash_ = PerfectHash.build(distinct)
    value = hash_(distinct)
    rows, prints = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    rows[value], prints[value] = first + nulls, prints_of(distinct)
    return {"shard": number, "n_ids": int(starts[-1]), "low": int(own[0]) if len(own) else None, "high": int(own[-1]) if len(own) else None, "keys": own.tobytes(), "starts": starts.tobytes(), "sizes": hash_.sizes.tobytes(),
            "bits": hash_.bits.tobytes(), "ranks": hash_.ranks.tobytes(), "rows": rows.tobytes(), "prints": prints.tobytes(), "payload": b"".join(parts), "width": width}


class Coder:
    """Ids of texts by a tokenizer file that lower-cases and drops white space, which no token crosses. Each distinct
    chunk between spaces or line ends is encoded once and kept while the chunks kept stay under `most` characters.

    A text of Latin letters is lower-cased and its chunks are split by the tokenizer's own pattern here, and the library
    encodes the distinct pieces, many in a call; that is all that its normaliser and splitter would do to them, at half
    the cost. The chunks of other texts go through the whole tokenizer, separated by MARK. Texts that hold an added
    token's string, which the library finds before all else, are encoded by it whole.
    """

    def __init__(self, path: str, end: int | None, most: int = 24_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.split = regex.compile(read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.added = [t["content"] for t in read["added_tokens"] if not t["normalized"]]
        loose = [re.escape(t["content"]) for t in read["added_tokens"] if t["normalized"]]
        self.loose = re.compile("|".join(loose), re.IGNORECASE) if loose else None
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(read["model"]["end_of_word_suffix"])]] = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        mark = self._ids([MARK])[0]
        assert len(mark) == 1 and self._ids(["ABC É"]) == self._ids(["abc é"])
        self.mark = mark[0]
        self.end = b"" if end is None else end.to_bytes(self.width, "little")
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        self.size = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _latin(self, chunks: list[str], together: int = 200) -> None:
        """Learns chunks in small Latin letters. Pieces hold no white space and leave none of the rest out, so the
        chunks are split side by side, and their lengths say which pieces are whose."""
        pieces = self.split(" ".join(chunks))
        place = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        new = [p for p in place if p not in self.pieces]
        for k in range(0, len(new), together):
            part = new[k : k + together]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids)
            ends = (self.width * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw = ids.astype(self.kind).tobytes()
            self.pieces.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        own = [self.pieces[p] for p in place]
        ids, n = np.frombuffer(b"".join(own), self.kind), np.fromiter(map(len, own), np.int64, len(own)) // self.width
        code = np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))
        end = np.append(0, np.cumsum(n[code]))
        raw = ids[np.repeat((np.cumsum(n) - n)[code] - end[:-1], n[code]) + np.arange(end[-1])].tobytes()
        cut = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))).searchsorted(np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))))
        at = [0, *(self.width * end[cut + 1]).tolist()]
        self.known.update(zip(chunks, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))

    def _other(self, chunks: list[str], together: int = 400) -> None:
        """Learns any chunks."""
        alone = [c for c in chunks if MARK in c]
        for c, ids in zip(alone, self._ids(alone), strict=True):
            self.known[c] = np.array(ids, self.kind).tobytes()
        rest = [c for c in chunks if MARK not in c]
        for k in range(0, len(rest), together):
            part = rest[k : k + together]
            ids = np.array(self._ids([f" {MARK} ".join(part)])[0])
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            assert len(cuts) == len(part) + 1
            raw = ids.astype(self.kind).tobytes()
            for c, a, b in zip(part, cuts, cuts[1:], strict=False):
                self.known[c] = raw[(a + 1) * self.width : b * self.width]

    def _window(self, texts: list[str]) -> Iterator[bytes]:
        whole = {k: self.library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts) if any(a in t for a in self.added) or (self.loose and self.loose.search(t))}
        plain = [_plain(t) for t in texts]
        found = [[] if k in whole else (t.lower() if p else t).replace("\n", " ").split(" ") for k, (t, p) in enumerate(zip(texts, plain, strict=True))]
        if self.size > self.most:
            self._clear()
        for learn, kind in ((self._latin, True), (self._other, False)):
            new = list(set().union(*[f for f, p in zip(found, plain, strict=True) if p == kind]).difference(self.known))
            if new:
                learn(new)
                self.size += sum(map(len, new)) + 20 * len(new)
        for k, chunks in enumerate(found):
            yield (np.array(whole[k]).astype(self.kind).tobytes() if k in whole else b"".join(map(self.known.__getitem__, chunks))) + self.end

    def __call__(self, texts: list[str], window: int = 1_000_000) -> Iterator[bytes]:
        """Ids of each text, a window of characters at a time; a longer text makes one alone."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= window:
                yield from self._window(held)
                held, size = [], 0
        yield from self._window(held)


def _plain(text: str) -> bool:
    """Whether the text has nothing BEYOND; ASCII is looked through for single characters, which is faster."""
    return not any(c in text for c in ODD_SPACES) if text.isascii() else not BEYOND.search(text)


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of every whole text to path, in ascending order of the keys, which are integers.

    The texts are dealt out by ranges of the key and encoded where they land, so ids move no more. A shard closes when
    it has shard_ids ids; a document is never cut. Null texts count as empty (the end id only); null keys come first;
    rows that repeat a key stand together. An empty table writes no shard.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    arrow = arrow_schema(spark, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number = Coder(tokenizer, end), TaskContext.get().partitionId() << 32
        keys, parts, size = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([_shard(number, keys, parts, code.width)], arrow)

        for batch in batches:
            for key, ids in zip(batch["key"].to_pylist(), code(batch["text"].to_pylist()), strict=True):
                keys.append(key)
                parts.append(ids)
                size += len(ids) // code.width
                if size >= shard_ids:
                    yield close()
                    keys, parts, size, number = [], [], 0, number + 1
        if keys:
            yield close()

    placed = documents.select(F.col(id_col).cast("long").alias("key"), whole_text(text_col).alias("text")).repartitionByRange("key").sortWithinPartitions("key")
    placed.mapInArrow(run, SCHEMA).write.option("compression", "none").option("parquet.block.size", SHARD_BYTES).parquet(path)


def bases(spark: SparkSession, path: str) -> DataFrame:
    """(shard, part, base, low, high): the ids of all shards before each. The sums of the parts, one for each task that
    wrote, are added up first, and then those within each part; five columns are read, a row a shard of some MB."""
    shards = spark.read.parquet(path).select("shard", F.shiftright("shard", 32).alias("part"), "n_ids", "low", "high")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("first"))
    own = before(Window.partitionBy("part").orderBy("shard"))
    return shards.withColumn("own", own).join(parts, "part").select("shard", "part", (F.col("first") + F.col("own")).alias("base"), "low", "high")


def _read(shards: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """What make() finds in shards, written; rows of shards have some MB each, so few go to a worker at a time."""
    spark = shards.sparkSession
    found = by_batch(shards, schema, make)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        return written(found, "read")
    finally:
        bounded_batches(spark)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, place) of every document, each found by its key through the index (null keys
    by their place). start counts the ids of all documents before it; the crc is that of 32-bit ids."""
    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {c: [] for c in ("doc_id", "start", "n_tokens", "ids_crc32", "place")}
            for row in batch.to_pylist():
                shard = Shard(row)
                found = np.concatenate([np.arange(shard.nulls), shard.find(shard.keys)])
                run = np.arange(len(found)) - found  # copies of a key before it
                assert (found >= 0).all() and (run >= 0).all()
                for n, first in enumerate(found.tolist()):
                    ids = shard.ids(first + int(run[n]))
                    out["doc_id"].append(None if n < shard.nulls else int(shard.keys[n - shard.nulls]))
                    out["start"].append(row["base"] + int(shard.starts[n]))
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    out["place"].append(n)
            return out

        return each

    first = written(bases(spark, path).select("shard", "base"), "bases")
    shards = spark.read.parquet(path).join(checked_broadcast(first, 32), "shard")
    return _read(shards, "doc_id long, start long, n_tokens long, ids_crc32 long, place long", make)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str, named: int = 1000) -> DataFrame:
    """(key, ids) of the documents with the wanted keys, ids as an array; keys that are not there give no row.

    The first keys of the parts, one for each task that wrote, come to the driver and lead a key to its part; there it
    joins the shards whose range holds it. If these are at most `named`, the scan names them, so that row groups without
    one are not read; else the shards are joined."""
    ranges = written(bases(spark, path).where("low is not null").select("shard", "part", "low", "high"), "ranges")
    parts = sorted((r["low"], r["part"]) for r in ranges.groupBy("part").agg(F.min("low").alias("low")).collect())
    lows, numbers = np.array([a for a, _ in parts], np.int64), np.array([-1, *[b for _, b in parts]], np.int64)

    def part_of():
        return lambda batch: {"key": batch["key"], "part": numbers[lows.searchsorted(batch["key"].to_numpy(), "right")]}

    wanted = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    placed = by_batch(wanted, "key long, part long", part_of).join(checked_broadcast(ranges, 64), "part").where(F.col("key").between(F.col("low"), F.col("high")))
    placed = written(placed.groupBy("shard").agg(F.collect_list("key").alias("wanted")), "placed")
    shards, some = spark.read.parquet(path), [r["shard"] for r in placed.select("shard").limit(named + 1).collect()]
    if len(some) <= named:
        shards, placed = shards.where(F.col("shard").isin(some)), F.broadcast(placed)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"key": [], "ids": []}
            for row in batch.to_pylist():
                shard, asked = Shard(row), np.array(row["wanted"], np.int64)
                for key, n in zip(asked.tolist(), shard.find(asked).tolist(), strict=True):
                    while n >= 0 and n < len(shard.starts) - 1 and shard.keys[n - shard.nulls] == key:
                        out["key"].append(key)
                        out["ids"].append(shard.ids(n).tolist())
                        n += 1
            return out

        return each

    return _read(shards.join(placed, "shard"), "key long, ids array<int>", make)


def op4_token_output(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document as read back from the files, as write_tokens() and
    read_documents() define them: null texts have the end id only, null keys come first, repeated keys stand together,
    other columns are not read, and an empty table gives no row."""
    import public_tokenizers as public

    spark = documents.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(documents, path, public.path("word_bpe_49k.json"))
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
