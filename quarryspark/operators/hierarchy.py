"""Chunks that follow a document's structure: each block with the path of its section, split only where it must be."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import token_estimate
from .chunking import SENTENCE_END, estimate, split_to_budget
from .corpus import body, noise
from .knowledge import BOILERPLATE

DIGEST = re.compile(r"(?i)sha256:[a-f0-9]{64}")
#: Kinds of block that may stand a twentieth over the budget, for the path before them.
SLACK = ("paragraph", "list")


def units(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(document_id, ord, node_type, path, text): the blocks that say something, with the title and the section above
    them as path. A heading alone is no unit: it is the path of what follows."""
    rows = blocks.where(F.col("node_type") != "heading").join(titles, "document_id", "left")
    path = F.filter(F.array(F.trim("title"), F.trim("section")), lambda p: F.coalesce(p, F.lit("")) != "")
    return rows.select("document_id", "ord", "node_type", path.alias("path"), "text")


def ranges(sizes: list[int], base: Callable[[int], int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of parts joined by one character that, behind base(first part) characters, stay within `most`
    tokens; a part that does not fit stands alone."""
    start, size = 0, 0
    for k, own in enumerate(sizes):
        more = size + (1 if k > start else 0) + own
        if k > start and max(1, int((base(start) + more) / 4 + 0.999)) > most:
            yield start, k
            start, more = k, own
        size = more
    if sizes:
        yield start, len(sizes)


def unit_chunks(kind: str, path: list[str], text: str, most: int, least: int) -> Iterator[tuple[str, str]]:
    """(method, content) of one unit. It stays whole within the budget; a longer table is cut between rows, each part with
    its header, a text between sentences, and a sentence between words. Chunks begin with the last two names of their
    path, unless their text does."""
    context = " > ".join(path[-2:]) if len(path) > 1 else ""

    def shown(body: str) -> str:
        return body if not context or body.startswith(context) else f"{context}\n\n{body}"

    body = DIGEST.sub("", text).strip()
    if not body:
        return
    n = estimate(shown(body))
    if n <= most or (kind in SLACK and n <= int(most * 1.05)):
        yield kind, shown(body)
        return
    lines = [x for x in body.splitlines() if x.strip()]
    if kind == "table" and len(lines) > 1:
        header, rows = lines[0], lines[1:]
        before = len(shown(header)) + 1
        for a, b in ranges([len(r) for r in rows], lambda k: before, most):
            yield kind, shown("\n".join([header, *rows[a:b]]))
        return
    sentences = [s.strip() for s in re.split(SENTENCE_END, body) if s.strip()]
    if len(sentences) > 1:
        for a, b in ranges([len(s) for s in sentences], lambda k: len(shown(sentences[k])) - len(sentences[k]), most):
            yield "sentence", shown(" ".join(sentences[a:b]))
        return
    for part in split_to_budget(body, most, least):
        yield "hard", shown(part)


def document_chunks(found: list[tuple[str, list[str], str]], most: int, least: int) -> list[tuple[list[str], str, str]]:
    """(path, method, content) of a document's units in order. What the path still puts over the budget is cut between
    words; a short end of such a cut joins the one before it in the same section, if both fit."""
    out: list[tuple[list[str], str, str]] = []
    for kind, path, text in found:
        for method, content in unit_chunks(kind, path, text, most, least):
            for part in [content] if estimate(content) <= most else split_to_budget(content, most, least):
                own = method if part is content else "hard"
                last = out[-1] if out else None
                if own == "hard" and last and last[:2] == (path, "hard") and estimate(part) < least and estimate(f"{last[2]}\n\n{part}") <= most:
                    out[-1] = (path, "hard", f"{last[2]}\n\n{part}")
                else:
                    out.append((path, own, part))
    return out


def _identity(version: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), F.col("document_id").cast("string"), F.lit("v1"), F.col("chunk_index").cast("string"), "content"), 256)


def hierarchical_chunks(rows: DataFrame, most: int = 150, least: int = 30, version: str = "v1") -> DataFrame:
    """(document_id, chunk_index, chunk_id, path, method, content, token_count) of units(). A document's units meet in one
    row, as its text did before; the rest is done where they are. Documents without a unit give no chunk."""
    kind = dict(rows.dtypes)["document_id"]
    gathered = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "node_type", "path", "text"))).alias("u"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("document_id", "chunk_index", "path", "method", "content")}
            for i, own in zip(batch["document_id"].to_pylist(), batch["u"].to_pylist(), strict=True):
                for k, (path, method, content) in enumerate(document_chunks([(x["node_type"], x["path"], x["text"]) for x in own], most, least)):
                    for c, x in zip(out, (i, k, path, method, content), strict=True):
                        out[c].append(x)
            yield pa.RecordBatch.from_pydict({"document_id": pa.array(out["document_id"], batch["document_id"].type), "chunk_index": pa.array(out["chunk_index"], pa.int32()), "path": pa.array(out["path"], pa.list_(pa.string())), "method": pa.array(out["method"], pa.string()), "content": pa.array(out["content"], pa.string())})

    found = gathered.mapInArrow(run, f"document_id {kind}, chunk_index int, path array<string>, method string, content string")
    return found.select("document_id", "chunk_index", _identity(version).alias("chunk_id"), "path", "method", "content", token_estimate(F.col("content")).alias("token_count"))


def filtered(chunks: DataFrame, confident: float = 0.85, version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(kept, suppressed) of hierarchical_chunks(). Debris that is surely so goes first; then, of chunks with one text,
    whatever its case and blanks, in one document and path, all but the first. suppressed: (document_id, chunk_index,
    path, method, token_count, reason, confidence, detail, preview), a row for each chunk dropped. Kept chunks are numbered
    anew, and their ids are made from that."""
    judged = chunks.withColumn("n", noise(F.col("content"), F.col("token_count"), F.col("method") == "hard")).withColumn("noisy", F.col("n.category").isNotNull() & (F.col("n.confidence") >= confident))
    text = F.sha2(F.lower(F.array_join(tx.words(F.col("content")), " ")), 256)
    same = Window.partitionBy("document_id", "path", "noisy", text).orderBy("chunk_index")
    judged = judged.withColumn("first", F.first("chunk_id").over(same)).withColumn("again", ~F.col("noisy") & (F.row_number().over(same) > 1))
    repeat = F.when(F.col("content").rlike(BOILERPLATE) | F.contains(F.lower(body(F.col("content"))), F.lit("left blank")), "boilerplate").otherwise("same_context_duplicate")
    shown = [F.col("document_id"), F.col("chunk_index"), F.col("path"), F.col("method"), F.col("token_count")]
    gone = judged.where("noisy or again").select(
        *shown, F.when(F.col("noisy"), F.col("n.category")).otherwise(repeat).alias("reason"), F.when(F.col("noisy"), F.col("n.confidence")).otherwise(1.0).alias("confidence"),
        F.when(F.col("noisy"), F.col("n.reason")).otherwise(F.concat(F.lit("duplicate_of="), "first")).alias("detail"), F.left("content", F.lit(200)).alias("preview"),
    )
    kept = judged.where("not noisy and not again").withColumn("chunk_index", (F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")) - 1).cast("int"))
    return kept.select("document_id", "chunk_index", _identity(version).alias("chunk_id"), "path", "method", "content", "token_count"), gone


def whole_units(rows: DataFrame, most: int = 150) -> DataFrame:
    """units() that need no cut, as (document_id, ord, content, token_count), by column functions alone."""
    context = F.when(F.size("path") > 1, F.concat(F.array_join(F.slice("path", -2, 2), " > ")))
    body = F.regexp_replace(F.regexp_replace("text", "(?i)sha256:[a-f0-9]{64}", ""), r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    shown = F.when(F.col("context").isNull() | F.startswith(F.col("body"), F.col("context")), F.col("body")).otherwise(F.concat("context", F.lit("\n\n"), "body"))
    made = rows.withColumn("context", context).withColumn("body", body).where("body <> ''").withColumn("content", shown)
    return made.select("document_id", "ord", "content", token_estimate(F.col("content")).alias("token_count")).where(F.col("token_count") <= most)


def tail_merges(chunks: DataFrame, least: int = 30) -> DataFrame:
    """(document_id, n_hard, n_short): how many chunks were cut between words, and how many of them are still short, that
    is, did not fit the chunk before them."""
    before = Window.partitionBy("document_id").orderBy("chunk_index")
    follows = (F.col("method") == "hard") & (F.lag("method").over(before) == "hard") & (F.col("token_count") < least)
    return chunks.withColumn("short", F.coalesce(follows, F.lit(False))).groupBy("document_id").agg(F.count_if(F.col("method") == "hard").alias("n_hard"), F.count_if("short").alias("n_short"))
