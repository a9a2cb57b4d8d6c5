"""Near-duplicate documents by b-bit MinHash: bands of minima propose candidates, the low bits of the minima estimate
their similarity by bit counts, and full shingle sets confirm each link."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import by_batch, by_group, checked_broadcast, paired_chunks, whole_text, written

BITS = 2  # of each minimum that the packed signature retains
SLOT = np.uint64(0x5555555555555555)
#: Members of a chunk of a large group, and characters of its texts.
CHUNK_ROWS, CHUNK_CHARS = 512, 16 << 20


@dataclass(frozen=True)
class Params:
    """Link documents whose sets of `words`-word shingles have 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    rows: int = 5  # minima in a band
    miss: float = 1e-5  # chance, at most, that two documents just at the threshold share no band

    @property
    def hashes(self) -> int:
        bands = math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))
        return 32 * math.ceil(bands * self.rows / 32)

    @property
    def bands(self) -> int:
        return self.hashes // self.rows

    @property
    def most_differing(self) -> int:
        """Differing slots up to which a candidate is looked at: those expected at the threshold, collisions of the
        retained bits corrected for, and five standard deviations."""
        match = (c := 0.5**BITS) + (1 - c) * self.percent / 100
        return math.ceil(self.hashes * (1 - match) + 5 * math.sqrt(self.hashes * match * (1 - match)))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: int, hashes: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: A-Z lower-cased, words between runs of white space as bytes 9-13
    and 32; fewer words give one shingle of them all, none give none."""
    found = text.encode().lower().split()  # bytes.lower and bytes.split know ASCII only
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    k = min(words, n)
    h = w[: n - k + 1].copy() + np.uint64(k)
    for i in range(1, k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[i : n - k + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(31)))


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    h = (s >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 1024):
        np.minimum(low, (h[k : k + 1024, None] * a + b).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> bytes:
    """The retained bits of the minima, two to a slot, as 64-bit words."""
    kept = ((low ^ (low >> np.uint32(13)) ^ (low >> np.uint32(23))) & np.uint32(3)).astype(np.uint64).reshape(-1, 32)
    return np.bitwise_or.reduce(kept << (np.arange(32, dtype=np.uint64) * np.uint64(BITS)), axis=1).tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matrix of the slots in which the signatures of x and y differ."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        d = x[:, None, k] ^ y[None, :, k]
        out += np.bitwise_count((d | d >> np.uint64(1)) & SLOT)
    return out


def sketches(documents: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, s1, s2, sig, bands): set size, 128-bit hash of the set, packed signature, band keys."""

    def make():
        rng = np.random.default_rng(8)
        a, b = rng.integers(0, 1 << 31, p.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, p.hashes, dtype=np.uint32)
        hashes = _Hashes()

        def each(batch: pa.RecordBatch) -> dict:
            if len(hashes) > 1_000_000:
                hashes.clear()
            out: dict[str, list] = {c: [] for c in ("n_shingles", "s1", "s2", "sig", "bands")}
            for text in batch["text"].to_pylist():
                s = shingles(text, p.words, hashes)
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                out["n_shingles"].append(len(s))
                out["s1"].append((whole >> 64) - (1 << 63))
                out["s2"].append((whole & (1 << 64) - 1) - (1 << 63))
                low = minima(s, a, b) if len(s) else None
                out["sig"].append(packed(low) if len(s) else None)
                out["bands"].append([xxhash.xxh3_64_intdigest(low[k * p.rows : (k + 1) * p.rows].tobytes(), k) - (1 << 63) for k in range(p.bands)] if len(s) else [])
            return {"id": batch["id"]} | out

        return each

    kind = dict(documents.dtypes)[id_col]
    return by_batch(documents.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")), f"id {kind}, n_shingles long, s1 long, s2 long, sig binary, bands array<long>", make)


class _Forest:
    """Union by smaller index, for the members of one group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _close_pairs(rows: list[dict], most: int, cross: bool) -> Iterator[tuple[int, int]]:
    """Pairs of members (of different chunks if cross) by rising difference of their signatures, up to `most`."""
    sig = np.array([np.frombuffer(r["sig"], np.uint64) for r in rows])
    own = np.array([r["own"] for r in rows])
    found = []
    for k in range(0, len(rows), 256):
        d = differing(sig[k : k + 256], sig)
        x, y = np.nonzero(d <= most)
        keep = (x + k > y) & ((own[x + k] != own[y]) | (not cross))
        found.append((d[x[keep], y[keep]], x[keep] + k, y[keep]))
    d, x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    order = np.argsort(d, kind="stable")
    yield from zip(x[order].tolist(), y[order].tolist(), strict=True)


def links(documents: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership, edges). membership: (id, n_shingles, rep), rep being the smallest id with the same set. edges:
    links (a, b) between reps, a spanning forest of all links: each link between different sets either is an edge or
    its ends are joined by edges.

    Sets that are equal collapse first. A band's bucket that holds more than one set is compared by signatures, and the
    estimates' components are confirmed on the full sets: each member against the first, and those that do not link with
    it against all others. Groups beyond a chunk are dealt out as pairs of chunks, so no task holds an unbounded group,
    and no task emits more than a forest.
    """
    sketch = written(sketches(documents.where(F.col(id_col).isNotNull()), p, id_col, text_col), "sketch")
    sets = written(sketch.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep")), "sets")
    member = written(sketch.join(sets, ["s1", "s2"]).select("id", "rep", "n_shingles", F.expr("if(id = rep, sig, null)").alias("sig"), F.expr("if(id = rep, bands, null)").alias("bands")), "member")
    reps = member.where("sig is not null").select("rep", "sig", "bands")
    banded = reps.select("rep", "sig", F.explode("bands").alias("band"))
    x, y = F.xxhash64("rep"), F.xxhash64("rep", F.lit(1))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y")).where("n > 1")
    buckets = written(buckets.groupBy("n", "lo", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "buckets")  # equal buckets once
    chunks = F.ceil(F.col("n") / CHUNK_ROWS)
    dealt = paired_chunks(banded.join(buckets, "band"), F.xxhash64("rep"), chunks).select("band", "i", "j", "own", "rep", "sig")
    kind = dict(member.dtypes)["rep"]
    most = p.most_differing

    def by_estimate(key: tuple, rows: list[dict]) -> Iterator[dict]:
        forest = _Forest(len(rows))
        for a, b in _close_pairs(rows, most, key[1] != key[2]):
            if forest.join(a, b) and rows[a]["rep"] != rows[b]["rep"]:
                yield {"a": rows[a]["rep"], "b": rows[b]["rep"]}

    candidates = components(by_group(dealt, ["band", "i", "j"], f"a {kind}, b {kind}", by_estimate), "a", "b")
    size = member.where("sig is not null").select(F.col("rep").alias("node"), "sig")
    candidates = written(candidates.join(size, "node").select("node", "component", "sig"), "candidates")
    texts = documents.select(F.col(id_col).alias("node"), whole_text(text_col).alias("text")).join(checked_broadcast(candidates, 160), "node")
    texts = written(texts, "texts")
    first = _linked_with_first(texts, p, kind)
    rest = _linked_with_others(texts, first, p, kind)
    edges = first.where("linked").select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest)
    return sketch.select("id", "n_shingles").join(member.select("id", "rep").distinct(), "id", "left"), edges


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if len(s) > len(t):
        s, t = t, s
    both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
    return 100 * both >= percent * (len(s) + len(t) - both)


def _linked_with_first(texts: DataFrame, p: Params, kind: str) -> DataFrame:
    """(component, node, linked): each member of a candidate component against the component's first, on full sets. A text
    moves once, and the first's text stands beside it; in a group of near copies this settles all or nearly all. A large
    component is dealt out by salt, a chunk of members with a copy of the first each, so it is in no one task."""
    member = texts.where(F.col("node") != F.col("component")).select("component", "node", "text")
    first = texts.where(F.col("node") == F.col("component")).groupBy("component").agg(F.min("text").alias("first"))
    sizes = checked_broadcast(written(member.groupBy("component").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("g")), "groups"), 24)
    salted = member.join(sizes, "component").select("component", "node", "text", F.pmod(F.xxhash64("node"), F.col("g")).cast("int").alias("salt"))
    copies = first.join(sizes, "component").select("component", "first", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("salt"))
    pairs = salted.join(copies, ["component", "salt"])

    def make():
        hashes, known = _Hashes(), {}

        def each(batch: pa.RecordBatch) -> dict:
            if len(hashes) > 1_000_000:
                hashes.clear()
            linked = []
            for c, text, other in zip(batch["component"].to_pylist(), batch["text"].to_pylist(), batch["first"].to_pylist(), strict=True):
                if c not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[c] = shingles(other, p.words, hashes)
                linked.append(_similar(shingles(text, p.words, hashes), known[c], p.percent))
            return {"component": batch["component"], "node": batch["node"], "linked": linked}

        return each

    return written(by_batch(pairs, f"component {kind}, node {kind}, linked boolean", make), "first")


def _linked_with_others(texts: DataFrame, first: DataFrame, p: Params, kind: str) -> DataFrame:
    """Edges (a, b) of the members that do not link with their component's first, and of ids that repeat, whose rows may
    differ: each of these meets every other member; the first, if it is one row, has met all. Both sides of a component are
    dealt out in chunks, so that no task holds an unbounded group."""
    settled = first.groupBy("component", "node").agg(F.min("linked").alias("linked"))
    n_rows = texts.groupBy("component", "node").agg(F.count("*").alias("n_rows"))
    state = n_rows.join(settled, ["component", "node"], "left").where("node <> component or n_rows > 1")
    rows = texts.join(state.select("component", "node", (F.coalesce("linked", F.lit(False)) & (F.col("n_rows") == 1)).alias("linked")), ["component", "node"])
    size = lambda of: F.greatest(F.ceil(F.count_if(of) / CHUNK_ROWS), F.ceil(F.sum(F.when(of, F.length("text"))) / CHUNK_CHARS)).cast("int")
    sizes = rows.groupBy("component").agg(size(~F.col("linked")).alias("gl"), size(F.lit(True)).alias("gr"), F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("n_open"))
    sizes = written(sizes.where("n_open > 0 and n > 1").select("component", "gl", "gr"), "sizes")
    dealt = rows.join(sizes, "component").withColumn("salt", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("salt", F.col(n)).cast("int")
    left = dealt.where(~F.col("linked")).select("component", own("gl").alias("i"), every("gr").alias("j"), F.lit(0).alias("own"), F.col("node").alias("rep"), "sig", "text")
    right = dealt.select("component", every("gl").alias("i"), own("gr").alias("j"), F.lit(1).alias("own"), F.col("node").alias("rep"), "sig", "text")

    def confirm(key: tuple, group: list[dict]) -> Iterator[dict]:
        hashes = _Hashes()
        sets = [shingles(r.pop("text"), p.words, hashes) for r in group]
        forest = _Forest(len(group))
        for a, b in _close_pairs(group, p.most_differing, True):
            if forest.find(a) != forest.find(b) and _similar(sets[a], sets[b], p.percent):
                forest.join(a, b)
                if group[a]["rep"] != group[b]["rep"]:
                    yield {"a": group[a]["rep"], "b": group[b]["rep"]}

    return by_group(left.union(right), ["component", "i", "j"], f"a {kind}, b {kind}", confirm)


def near_duplicates(documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: component_id is the smallest id reachable by links.

    Null and empty texts have no shingles and link with nothing; a row with a null id has null component_id and
    n_shingles and is kept. Rows that repeat an id are one node: their links are joined.
    """
    membership, edges = links(documents, p, id_col, text_col)
    found = written(components(edges, "a", "b"), "components")
    joined = membership.join(found, membership["rep"] == found["node"], "left")
    component = F.coalesce("component", "rep", "id")
    out = joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component == F.col("id")).alias("kept"))
    none = documents.where(F.col(id_col).isNull()).select(id_col, F.lit(None).cast("long").alias("n_shingles"), F.col(id_col).alias("component_id"), F.lit(True).alias("kept"))
    return out.union(none)


def kept_documents(documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents with one document of each group: that with the smallest id."""
    dropped = near_duplicates(documents, p, id_col, text_col).where("not kept").select(id_col).distinct()
    return documents.join(dropped, id_col, "left_anti").select(documents.columns)


def op8_minhash(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document for three words and 85 percent, as near_duplicates()
    defines them."""
    return near_duplicates(documents, Params(words=3, percent=85))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id, s.doc_id = min(r.b) AS kept FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
