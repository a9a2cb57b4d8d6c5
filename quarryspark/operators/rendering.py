"""Documents as text again, by their type: what is embedded and read, from flat blocks in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import written
from .knowledge import faq_text

#: The line between a table's head and its rows.
RULE = r"^\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"


def cells(text: Column) -> Column:
    """A table's lines as arrays of trimmed cells; the first is the head. A rule below the head is left out."""
    lines = F.filter(F.split(tx.filled(text), "\n"), lambda x, i: ~((i == 1) & F.trim(x).rlike(RULE)))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))


def table_lines(text: Column) -> Column:
    return F.transform(cells(text), lambda row: F.array_join(row, " | "))


def list_lines(text: Column) -> Column:
    return F.transform(F.filter(F.split(tx.filled(text), "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), F.trim(x)))


def clean_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(tx.filled(title), r"[ \t\n\r\f\x0B]+", " "))


def product_name(title: Column, url: Column) -> Column:
    """By the last part of a shop's URL, each run of letters with a capital first; else by the title."""
    slug = F.replace(F.element_at(F.split(F.rtrim(tx.filled(url), F.lit("/")), "/"), -1), F.lit("-"), F.lit(" "))
    capital = F.replace(F.initcap(F.regexp_replace(slug, r"([^\p{L}])(?=\p{L})", "$1\u0001 ")), F.lit("\u0001 "), F.lit(""))
    own = clean_title(title)
    return F.when(F.contains(F.lower(tx.filled(url)), F.lit("/products/")), capital).when(F.lower(own).endswith(".pdf"), F.replace(own, F.lit(".pdf"), F.lit(""))).otherwise(F.trim(own, F.lit(" -–")))


def _joined(rows: DataFrame) -> DataFrame:
    """(document_id, text) of parts (document_id, place, part): those that are not blank, in order."""
    parts = rows.where(F.trim("part") != "").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("p"))
    return parts.select("document_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"))


def _policy(rows: DataFrame) -> DataFrame:
    """Parts of policies: a section's name that the part before it holds is left out. What stands before a name may have
    been left out itself, so names in a row, of which there are few, are decided one after the other; all else is not
    gathered. The title stands before the first."""
    order = Window.partitionBy("document_id").orderBy("ord")
    name = (F.col("node_type") == "heading") & (F.coalesce("level", F.lit(1)) <= 2)
    runs = rows.withColumn("name", name).withColumn("run", F.sum(F.when(F.col("name"), 0).otherwise(1)).over(order))
    each = runs.groupBy("document_id", "run").agg(
        F.min("ord").alias("ord"), F.max("title").alias("title"), F.max(F.when(~F.col("name"), F.col("part"))).alias("opener"),
        F.array_sort(F.collect_list(F.when(F.col("name") & (F.col("part") != ""), F.struct("ord", "part")))).alias("names"),
    )
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.when(F.col("run") == 0, F.col("title")).otherwise(tx.filled(F.col("opener"))).alias("last"))
    step = lambda a, x: F.when(F.contains(F.lower(a["last"]), F.lower(x["part"])), a).otherwise(F.struct(F.concat(a["kept"], F.array(x["part"])).alias("kept"), x["part"].alias("last")))
    kept = F.aggregate("names", start, step, lambda a: a["kept"])
    parts = F.filter(F.concat(F.array(tx.filled(F.col("opener"))), kept), lambda p: F.trim(p) != "")
    return each.select("document_id", F.struct(F.col("ord"), F.lit(1).alias("k")).alias("place"), F.array_join(parts, "\n\n").alias("part"))


def rendered(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, text) of documents (document_id, title, url, document_type, source_type) and their blocks (document_id,
    ord, node_type, level, text, page), `page` being null where there are none.

    Policies begin with their title and leave out section names that the part before holds; lists of questions become
    pairs (faq_text); products begin with their name; papers, which are those of source type pdf or scanned_pdf and all
    others with pages, name the document; other pages begin with the title. In the last two a heading that repeats the one
    before it on its page is left out. Pages are named where they begin; policies have no part of their pages. Lists
    are lines with dashes, tables lines of cells. Blank parts go, and a document without any has its head alone; documents
    come once each, so repeated ids must be made apart before. Blocks are made once and written, and those of a document
    meet in one row in the end, as its text did."""
    title, kind = clean_title(F.col("title")), F.col("node_type")
    policy, faq, product = (F.col("document_type") == t for t in ("policy", "faq", "product"))
    own = documents.select("document_id", title.alias("title"), "url", F.coalesce("document_type", F.lit("")).alias("document_type"), F.coalesce(F.col("source_type").isin("pdf", "scanned_pdf"), F.lit(False)).alias("paper"))
    text = F.when(kind == "list", F.array_join(list_lines(F.col("text")), "\n")).when(kind == "table", F.array_join(table_lines(F.col("text")), "\n")).otherwise(F.trim(tx.filled(F.col("text"))))
    rows = written(blocks.join(own.where(~faq), "document_id").withColumn("part", text).drop("text"), "rendered")  # read by each kind of part below
    before = Window.partitionBy("document_id", "page").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    heading = (kind == "heading") & (F.col("part") != "")
    others = rows.where(~policy).withColumn("above", F.last(F.when(heading, F.col("part")), ignorenulls=True).over(before))
    stay = product | ~heading | F.coalesce(F.col("above") != F.col("part"), F.lit(True))
    place = lambda k: F.struct(F.col("ord"), F.lit(k).alias("k")).alias("place")
    parts = others.where(stay).select("document_id", place(1), "part")
    paged = rows.where(~policy & F.col("page").isNotNull()).groupBy("document_id", "page", "document_type").agg(F.min("ord").alias("ord"))
    named = F.concat(F.when(product, "Page ").otherwise("Page:\n"), F.col("page").cast("string"))
    parts = parts.unionByName(paged.select("document_id", place(0), named.alias("part"))).unionByName(_policy(rows.where(policy & F.col("page").isNull())))
    whole = own.where(~faq).join(_joined(parts), "document_id", "left").join(paged.select("document_id").distinct().withColumn("pages", F.lit(True)), "document_id", "left")
    head = F.when(product, F.concat(F.lit("Product:\n"), product_name(F.col("title"), F.col("url")))).when(~policy & (F.col("paper") | F.col("pages").isNotNull()), F.concat(F.lit("Document:\n"), F.col("title"))).otherwise(F.col("title"))
    found = whole.select("document_id", F.array_join(F.filter(F.array(head, tx.filled(F.col("text"))), lambda p: F.trim(p) != ""), "\n\n").alias("text"))
    lists = own.where(faq)
    return found.unionByName(faq_text(blocks.join(lists.select("document_id"), "document_id", "left_semi"), lists))


def preview(blocks: DataFrame) -> DataFrame:
    """(document_id, text): names, texts, items and lines of cells, each a part of its own, in order."""
    kind = F.col("node_type")
    items = F.when(kind == "list", F.split(tx.filled(F.col("text")), "\n")).when(kind == "table", table_lines(F.col("text"))).otherwise(F.array(tx.filled(F.col("text"))))
    part = F.array_join(F.filter(items, lambda x: F.trim(x) != ""), "\n\n")
    return _joined(blocks.select("document_id", F.col("ord").alias("place"), part.alias("part")))
