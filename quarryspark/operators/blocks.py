"""The document tree as a flat table of blocks, in document order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def markdown_blocks(documents: DataFrame) -> DataFrame:
    """(document_id, ord, node_type, level, section, n_lines, text) of (doc_id, text) in Markdown.

    A line is blank, a table row, a heading, a list item or text. A block is a run of lines of one kind; each heading is
    its own, and a list ends where the indent changes. Headings of level 1 and 2 open the section that the blocks behind
    them belong to. Text of a block: its trimmed lines; of a list its items. Null texts have no blocks.
    """
    line = F.col("line")
    own = F.trim(line)
    heading = own.rlike(r"^#{1,6}\s+.+$") & ~F.contains(own, F.lit("!["))
    kind = F.when(own == "", "blank").when(own.rlike(r"^\|(.+)\|$"), "table").when(heading, "heading").when(line.rlike(r"^\s*[*\-]\s+.+$"), "list").otherwise("paragraph")
    lines = documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("kind", kind)
    lines = lines.withColumn("indent", F.when(F.col("kind") == "list", F.length(F.regexp_extract("line", r"^(\s*)", 1))).otherwise(0))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(own, "^(#+)", 1)))
    content = F.when(F.col("kind") == "heading", F.trim(F.regexp_replace(own, r"^#+\s+", ""))).when(F.col("kind") == "list", F.trim(F.regexp_replace(own, r"^[*\-]\s+", ""))).otherwise(own)
    order = Window.partitionBy("document_id").orderBy("at")
    new = (F.col("kind") != F.lag("kind").over(order)) | (F.col("kind") == "heading") | (F.col("indent") != F.lag("indent").over(order))
    lines = lines.withColumn("level", level).withColumn("content", content).withColumn("ord", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(order))
    lines = lines.withColumn("section", F.last(F.when(F.col("level") <= 2, F.col("content")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), "\n")
    rows = lines.where("kind <> 'blank'").groupBy("document_id", "ord").agg(F.first("kind").alias("node_type"), F.max("level").alias("level"), F.first("section").alias("section"), F.count("*").alias("n_lines"), text.alias("text"))
    return rows.select("document_id", "ord", "node_type", "level", "section", "n_lines", "text")


def plain_text(blocks: DataFrame, between: str = "\n\n") -> DataFrame:
    """(document_id, text): the blocks' texts in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return blocks.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), between).alias("text"))


def structure_counts(blocks: DataFrame) -> DataFrame:
    """(document_id, headings, lists, tables, paragraphs, giants, repeated_headings)."""
    n = lambda kind: F.count_if(F.col("node_type") == kind)
    giant = F.count_if((F.col("node_type") == "paragraph") & (F.length("text") >= 400))
    headings = F.col("node_type") == "heading"
    return blocks.groupBy("document_id").agg(
        n("heading").alias("headings"), n("list").alias("lists"), n("table").alias("tables"), n("paragraph").alias("paragraphs"), giant.alias("giants"),
        (F.count_if(headings) - F.count_distinct(F.when(headings, F.col("text")))).alias("repeated_headings"),
    )


def coverage(texts: DataFrame, others: DataFrame) -> DataFrame:
    """(document_id, share): how many of a text's distinct words of three or more letters the other text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(tx.filled(F.col(c))), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))
    both = texts.select("document_id", words("text").alias("a")).join(others.select("document_id", words("text").alias("b")), "document_id")
    return both.select("document_id", F.when(F.size("a") == 0, 1.0).otherwise(F.bround(F.size(F.array_intersect("a", "b")) / F.size("a"), 4)).alias("share"))
