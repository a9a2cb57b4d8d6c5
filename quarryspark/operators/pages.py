"""Pages of documents without the lines that repeat over them: headers, footers and page marks. Only distinct lines and
their counts are moved; no document is gathered, whatever its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .structure import LINE_END, stripped, with_blocks

#: A heading line, and the most words of one.
HEADING, MOST_WORDS = r"""^[A-Z][A-Z0-9 \-/&(),.'"]{3,}$""", 12


def _own_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(tx.filled(text), "\n"), stripped), lambda x: x != "")


def repeated_lines(pages: DataFrame, least_pages: int = 2) -> DataFrame:
    """(document_id, line, n, n_pages) of pages (document_id, page, text): the lines, without blanks around them, that occur
    in a document half as often as it has pages, twice at least. Documents of fewer pages have none. Null texts have no
    lines, but are pages."""
    per_page = pages.select("document_id", F.explode(_own_lines(F.col("text"))).alias("line")).groupBy("document_id", "line").agg(F.count("*").alias("n"))
    size = pages.groupBy("document_id").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least_pages)
    return per_page.where("n >= 2").join(size, "document_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") / 2))).select("document_id", "line", "n", "n_pages")


def without_repeated(pages: DataFrame, repeated: DataFrame, footers: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, page, text, removed): the pages' lines without blanks around them, but for repeated ones and those that
    match a footer pattern; `removed` lists these as they came. A page meets only those repeated lines that it holds."""
    keyed = pages.select("document_id", "page", "text")
    held = keyed.select("document_id", "page", F.explode(F.array_distinct(_own_lines(F.col("text")))).alias("line"))
    gone = held.join(repeated.select("document_id", "line"), ["document_id", "line"]).groupBy("document_id", "page").agg(F.collect_set("line").alias("gone"))
    rows = keyed.join(gone, ["document_id", "page"], "left")
    drops = lambda x: F.coalesce(F.array_contains("gone", x), F.lit(False)) | _any(x, footers)
    lines = F.transform(F.split(tx.filled(F.col("text")), "\n"), stripped)
    kept = F.array_join(F.filter(lines, lambda x: (x == "") | ~drops(x)), "\n")
    return rows.select("document_id", "page", tx.tidy(kept).alias("text"), F.filter(lines, lambda x: (x != "") & drops(x)).alias("removed"))


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | line.rlike(p)
    return found


def page_blocks(pages: DataFrame, heading: str = HEADING) -> DataFrame:
    """(document_id, page, ord, node_type, text): headings, and paragraphs of the lines between them and blank lines. A
    page without a line is one empty paragraph."""

    def line(raw: Column) -> Column:
        own = stripped(raw)
        kind = F.when(own == "", "blank").when(own.rlike(heading) & (F.size(tx.words(own)) <= MOST_WORDS), "heading").otherwise("paragraph")
        return F.struct(kind.alias("kind"), own.alias("text"))

    found = with_blocks(pages.withColumn("text", tx.filled(F.col("text"))), "text", lambda t: F.transform(F.split(t, LINE_END), line))
    none = F.array(F.struct(F.lit("paragraph").alias("kind"), F.lit("").alias("text")))
    return found.select("document_id", "page", F.posexplode(F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(none)).alias("ord", "b")).select("document_id", "page", "ord", F.col("b.kind").alias("node_type"), F.col("b.text").alias("text"))
