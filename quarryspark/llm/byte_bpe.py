"""Byte-level BPE by merge replay at corpus level. The corpus's chunks are counted once; those seen most often are laid
out by partitions, an inverted index leads from each token pair to its positions, and every merge is applied in rank order
to all its positions at once, touching only their neighbours. The result, a table of bounded size, goes to every task;
chunks beyond it are replayed in the same way where they stand, a window of texts at a time, so no chunk is left out."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, by_batch, whole_text, written

END, GONE = -1, -2
#: Characters of texts, and of chunks remembered, that a task holds at a time; longer texts are held alone.
WINDOW_CHARS, KNOWN_CHARS = 6_000_000, 6_000_000
#: A place where a space stands behind white space: there no chunk may begin.
SPACES = re.compile(r"\s ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


class Replay:
    """The merges of one rank table. encode() is exact for any words: of all pairs of a word the one with the lowest
    rank is merged first, the leftmost of equal ones."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], END)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank, which is the id, of each pair's merge; END where there is none or a word ends."""
        key = a << 32 | b
        at = self.pairs.searchsorted(key)
        return np.where(self.pairs[at] == key, self.merged[at], END)

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size + 1) - size - 1
        token = np.full(int(size.sum()) + len(words), END)
        inside = np.ones(len(token), bool)
        inside[begin + size] = False
        token[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.append(np.arange(1, len(token)), 0), np.arange(-1, len(token) - 1)
        rank_at = np.append(self.ranks_of(token[:-1], token[1:]), END)  # of the pair that begins at each place
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        present, start = np.unique(rank_at[places], return_index=True)
        index = dict(zip(present.tolist(), np.split(places, start[1:]), strict=True)) if len(places) else {}
        added: dict[int, list[int]] = {r: [] for r in index}
        heap, late = list(added), []
        while heap:
            rank = heapq.heappop(heap)
            new, at = added.pop(rank), index.pop(rank, None)
            if new:
                at = np.sort(np.concatenate([at, new]) if at is not None else np.array(new))
                at = at[np.append(True, at[1:] != at[:-1])]
            at = at[rank_at[at] == rank]
            second = after[at]
            meet = second[:-1] == at[1:]
            if meet.any():  # of places that share a token, every other one from the left
                place = np.arange(len(at))
                keep = (place - np.maximum.accumulate(np.where(np.append(True, ~meet), place, 0))) % 2 == 0
                at, second = at[keep], second[keep]
            right = after[second]
            token[at], token[second], rank_at[second] = rank, GONE, END
            after[at], before[right] = right, at
            touched = np.concatenate([before[at], at])
            found = self.ranks_of(token[touched], token[after[touched]])
            rank_at[touched] = found
            good = found >= 0
            for r, i in zip(found[good].tolist(), touched[good].tolist(), strict=True):
                if r in added:
                    added[r].append(i)
                else:
                    added[r] = [i]
                    heapq.heappush(heap, r)
                if r < rank:
                    late.append(i)
        if late:
            return self._with_late(words, token, begin, np.unique(begin.searchsorted(late, "right") - 1))
        live = token >= 0
        return token[live], np.add.reduceat(live, begin, dtype=np.int64) if len(words) else np.zeros(0, np.int64)

    def _with_late(self, words: list[bytes], token: np.ndarray, begin: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a merge made a pair of lower rank, as tables that no training made can have it, that pair comes before
        the word's other places: such words are replayed one merge at a time."""
        parts = [p[p >= 0].tolist() for p in np.split(token, begin[1:])]
        for k in late.tolist():
            ids = self.single[list(words[k])]
            while len(ids) > 1:
                found = self.ranks_of(ids[:-1], ids[1:])
                if found.max() < 0:
                    break
                i = int(np.where(found >= 0, found, np.iinfo(np.int64).max).argmin())
                ids = np.concatenate([ids[:i], found[i : i + 1], ids[i + 2 :]])
            parts[k] = ids.tolist()
        return np.array([i for p in parts for i in p], np.int64), np.array([len(p) for p in parts])

    def encode(self, words: list[bytes]) -> list[list[int]]:
        ids, n = self.flat(words)
        return [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] if words else []


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Splitter:
    """Cuts texts into chunks that no match of the pattern crosses: a text's first chunk, and the rest. Where
    `spaces_begin` holds, every space behind a character that is no white space begins a chunk, which is listed without
    that space (`lead`). Else the first is empty and each match is a chunk."""

    def __init__(self, pattern: str, spaces_begin: bool):
        self.find, self.spaces_begin, self.lead = regex.compile(pattern).findall, spaces_begin, " " if spaces_begin else ""

    def __call__(self, text: str) -> tuple[str, list[str]]:
        if not self.spaces_begin:
            return "", self.find(text)
        if SPACES.search(text):
            first, *rest = BEFORE_SPACE.split(text)
            return first, [c[1:] for c in rest]
        first, *rest = text.split(" ")
        return first, rest

    def words(self, chunk: str) -> list[str]:
        return self.find(chunk) if self.spaces_begin else [chunk]


class Chunks:
    """Ids of chunks, as little-endian unsigned 32-bit integers: those of the table, and those met since, which are
    replayed together, a window of texts at a time."""

    def __init__(self, replay: Replay, split: Splitter, table: dict[str, bytes]):
        self.replay, self.split, self.table = replay, split, table
        self._clear()

    def _clear(self) -> None:
        self.firsts, self.rest, self.size = {"": b""}, dict(self.table), 0

    def learn(self, firsts: set[str], rest: set[str]) -> None:
        """Adds chunks. Those behind a space that end in no white space stand side by side for the pattern, as they do
        in texts; the others are cut alone."""
        alone = [(self.firsts, c, self.split.words(c)) for c in firsts]
        if self.split.spaces_begin:
            ends = {c for c in rest if not c or c[-1].isspace()}
            alone += [(self.rest, c, self.split.words(" " + c)) for c in ends]
            chunks = list(rest - ends)
            words = self.split.find("".join([f" {c}" for c in chunks]))
            cut = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1)
            cut = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))).searchsorted(cut) + 1)
        else:
            words = chunks = list(rest)
            cut = np.arange(len(chunks) + 1)
        words = words + [w for _, _, own in alone for w in own]
        cut = np.append(cut, cut[-1] + np.cumsum([len(own) for _, _, own in alone]).astype(np.int64))
        place = {w: k for k, w in enumerate(dict.fromkeys(words))}
        ids, n = self.replay.flat([w.encode("utf-8", "surrogatepass") for w in place])
        code = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        size = n[code] if len(code) else np.zeros(0, np.int64)
        end = np.append(0, np.cumsum(size))
        raw = ids[np.repeat((np.cumsum(n) - n)[code] - end[:-1], size) + np.arange(end[-1])].astype("<u4").tobytes() if len(code) else b""
        at = (4 * end[cut]).tolist()
        parts = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
        self.rest.update(zip(chunks, parts, strict=False))
        for (known, chunk, _), part in zip(alone, parts[len(chunks) :], strict=True):
            known[chunk] = part
        self.size += sum(map(len, chunks)) + 50 * len(chunks) + sum(len(c) + 50 for _, c, _ in alone)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.size > KNOWN_CHARS:
            self._clear()
        found = [self.split(t) for t in texts]
        firsts = {f for f, _ in found}.difference(self.firsts)
        rest = set().union(*[r for _, r in found]).difference(self.rest)
        if firsts or rest:
            self.learn(firsts, rest)
        of = self.rest.__getitem__
        return [b"".join([self.firsts[f], *map(of, r)]) for f, r in found]


def in_windows(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """Batches whose texts come to a window, and their texts."""
    held, texts, size = [], [], 0
    for batch in batches:
        own = batch[column].to_pylist()
        held.append(batch)
        texts += own
        size += sum(map(len, own))
        if size >= WINDOW_CHARS:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def frequent_chunks(texts: DataFrame, replay: Broadcast, pattern: str, spaces_begin: bool, most: int, longest: int) -> dict[str, bytes]:
    """The ids of the chunks that are seen most often in all texts, each at least twice and of at most `longest`
    characters: as many whole grades of counts as give at most `most` chunks. Every task counts its own chunks first, the
    counts are summed by chunk, the least grade follows from a histogram, and the merges of the chunks above it are
    replayed by partitions of the chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = Splitter(pattern, spaces_begin), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(c, n) for c, n in counts.items() if len(c) <= longest]
            counts.clear()
            for k in range(0, len(rows), 20_000):
                chunk, n = zip(*rows[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk, pa.string()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(split(text)[1])
            if len(counts) > 400_000:
                yield from flush()
        yield from flush()

    bounded_batches(texts.sparkSession)
    counted = texts.mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where("n > 1")
    counted = written(counted.select("chunk", F.floor(16 * F.log2("n")).cast("int").alias("grade")), "chunks")
    least, total = None, 0
    for grade, n in sorted(counted.groupBy("grade").agg(F.count("*")).collect(), reverse=True):
        total += n
        if total > most:
            break
        least = grade

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(replay.value, Splitter(pattern, spaces_begin), {})
        chunks.learn(set(), {c for batch in batches for c in batch["chunk"].to_pylist()})  # at most `most` of them
        rows = list(chunks.rest.items())
        for k in range(0, len(rows), 20_000):
            chunk, ids = zip(*rows[k : k + 20_000], strict=True)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk, pa.string()), "ids": pa.array(ids, pa.binary())})

    if least is None:
        return {}
    found = counted.where(F.col("grade") >= least).select("chunk").mapInArrow(merge, "chunk string, ids binary").toArrow()
    return dict(zip(found["chunk"].to_pylist(), found["ids"].to_pylist(), strict=True))


def encoded(documents: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), spaces_begin: bool = False, table_chunks: int = 150_000, table_chars: int = 48) -> DataFrame:
    """(keep..., ids) for every row and whole text: ids as little-endian unsigned 32-bit integers, without special
    tokens. A null or empty text gives no ids; rows that repeat are encoded each; an empty table gives no row; columns
    not named by `keep` are not read, so none can clash.

    `spaces_begin` says that no match of the pattern crosses, or looks over, the border between a character that is no
    white space and a space behind it; texts are then cut there, and the pattern sees each distinct chunk once. The table
    of frequent chunks has at most table_chunks of at most table_chars characters; it and the ranks are all that is sent
    to the workers. Texts do not move.
    """
    spark = documents.sparkSession
    replay = spark.sparkContext.broadcast(Replay(read_ranks(ranks_path)))
    narrow = documents.select(F.struct(*keep).alias("kept"), whole_text(text_col).alias("text"))
    table = spark.sparkContext.broadcast(frequent_chunks(narrow.select("text"), replay, pattern, spaces_begin, table_chunks, table_chars))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(replay.value, Splitter(pattern, spaces_begin), table.value)
        for held, texts in in_windows(batches):
            ids, at = chunks(texts), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([batch["kept"], pa.array(ids[at : at + batch.num_rows], pa.binary())], names=["kept", "ids"])
                at += batch.num_rows

    bounded_batches(spark)
    return narrow.mapInArrow(run, f"kept {dict(narrow.dtypes)['kept']}, ids binary").select("kept.*", "ids")


def decoded(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., n_tokens, ids_sha256, decoded): the bytes that the ids stand for. Null ids count as none."""
    narrow = tokens.select(F.struct(*keep).alias("kept"), F.col(ids_col).alias("ids"))
    ranks = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        table = np.empty(max(ranks.value.values()) + 1, object)
        for token, rank in ranks.value.items():
            table[rank] = token

        def each(batch: pa.RecordBatch) -> dict:
            ids = [x or b"" for x in batch["ids"].to_pylist()]
            return {
                "kept": batch["kept"],
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded": [b"".join(table[np.frombuffer(x, "<u4")].tolist()) for x in ids],
            }

        return each

    return by_batch(narrow, f"kept {dict(narrow.dtypes)['kept']}, n_tokens long, ids_sha256 string, decoded binary", make).select("kept.*", "n_tokens", "ids_sha256", "decoded")


def op2_byte_bpe(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, as encoded() and decoded() define them. The
    pattern of the public tokenizers takes white space only at the beginning of a match and looks ahead only from white
    space, so spaces begin chunks."""
    import public_tokenizers as public

    path = public.path("byte_bpe_multi_50k.tiktoken")
    tokens = encoded(documents.select("doc_id", "text"), path, public.PATTERN, spaces_begin=True)
    return decoded(tokens, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
