"""Knowledge in blocks and chunks: questions with answers, repeats in and across documents, whether questions are covered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.scratch import written
from . import anchors
from .corpus import body, first_that, kept_first

INLINE_QUESTION = r"(?i)Q[0-9]+\.[ \t\n\r\f\x0B]+[^\n]"


def _pair(question: Column, answer: Column) -> Column:
    """A question with its answer; null without an answer."""
    asked = F.concat(F.rtrim(F.trim(question), F.lit("?")), F.lit("?"))
    return F.when(F.trim(answer) != "", F.concat(F.lit("Question:\n"), asked, F.lit("\n\nAnswer:\n"), F.trim(answer)))


def faq_text(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(document_id, text): a list of questions as text. A heading that ends in a question mark is answered by the next
    block; a paragraph that begins with Q and asks within 120 characters holds both. Headings that answer nothing are
    left out, and so are paragraphs of numbered questions (their answers are unknown), which also answer nothing. A
    document of no text has its title. One window over each document's blocks."""
    kinds = blocks.where(F.col("node_type").isin("heading", "paragraph", "list"))
    rows = kinds.where(~((F.col("node_type") == "paragraph") & F.col("text").rlike(INLINE_QUESTION)))
    kind, own = F.col("node_type"), F.trim("text")
    asks = (kind == "heading") & own.endswith("?")
    order = Window.partitionBy("document_id").orderBy("ord")
    rows = rows.withColumn("asked", F.lag(F.when(asks, own)).over(order))
    text = F.when(kind == "list", F.array_join(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), F.trim(x))), "\n")).otherwise(own)
    at = F.locate("?", own)
    inline = (kind == "paragraph") & F.upper(own).startswith("Q") & at.between(1, 120)
    out = (
        F.when(asks, None).when(F.col("asked").isNotNull(), _pair(F.col("asked"), text)).when(kind == "heading", None)
        .when(inline, _pair(F.substring(own, F.lit(1), at), F.substring(own, at + 1, F.length(own)))).otherwise(text)
    )
    parts = rows.withColumn("part", out).where(F.trim("part") != "").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("p"))
    joined = parts.select("document_id", F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("text"))
    title = F.trim(F.regexp_replace(tx.filled(F.col("title")), r"[ \t\n\r\f\x0B]+", " "))
    return titles.select("document_id", title.alias("title")).join(joined, "document_id", "left").select("document_id", F.coalesce("text", "title").alias("text"))


#: Lines of forms, and parts of links that only lead around a shop.
FORM_LINES = r"(?i)^(Name\*?|Email\*?|Phone number\*?|Your City/ZIP/PIN Code|Comment|Send|Send Message|Message Us|Drop Us Message for Any Query|Contact form|Let's get in touch|Skip to content|Add to cart|Filter and sort|Taxes and shipping calculated at checkout)$"


def sanitized(text: Column) -> Column:
    """A text without images, heading marks, digests of the pipeline, lines of forms and lists of links; links keep their
    label; lines are trimmed and empty blocks go."""
    text = F.regexp_replace(F.regexp_replace(tx.filled(text), r"!\[[^\]]*\]\([^)]+\)", ""), r"(?m)^#{1,6}[ \t]+", "")
    blocks = F.transform(F.split(text, "\n\n"), _clean_block)
    return F.trim(F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n"))


def _clean_block(block: Column) -> Column:
    lines = F.filter(F.transform(F.split(block, "\n"), lambda s: F.regexp_replace(s, r"^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$", "")), lambda s: (s != "") & ~(s.startswith("- [") & F.contains(s, F.lit("](http"))))
    shown = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\[([^\]]+)\]\(https?://[^)]+\)", "$1"), r"(?i)sha256:[a-f0-9]{64}", "")))
    return F.array_join(F.filter(shown, lambda s: (s != "") & ~s.rlike(FORM_LINES)), "\n")


#: What repeats on purpose in a document.
BOILERPLATE = r"(?i)(left blank|by order of the board|make in india|all rights reserved)"


def repeat_class(same_path: Column, content: Column) -> Column:
    """What a chunk is that says the same as an earlier one: boilerplate, the same in the same place, a heading, or the
    same in another context."""
    own, boiler = body(content), tx.filled(content).rlike(BOILERPLATE)
    heading = own.rlike(r"^[A-Z0-9][A-Z0-9 \t\n\r\f\x0B&,\-./():'\"]{2,80}$") | (F.length(own) < 35) | F.contains(F.lower(content), F.lit("you may also like"))
    return first_that(
        (boiler, "BOILERPLATE"), (same_path, "SAME_CONTEXT_DUPLICATE"), ((F.length(own) >= 40) | F.contains(own, F.lit(".")) | F.contains(own, F.lit(":")), "DIFFERENT_CONTEXT_REPEAT"), (heading, "DUPLICATE_HEADING"),
        (F.lit(True), "DIFFERENT_CONTEXT_REPEAT"),
    )


def document_repeats(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_index, duplicate_of, class): chunks whose normalised text stood before in their document.
    chunks: (document_id, chunk_index, path, content)."""
    keyed = chunks.withColumn("key", F.sha2(tx.match_text(F.col("content")), 256))
    first = keyed.groupBy("document_id", "key").agg(F.min(F.struct("chunk_index", "path")).alias("f"))
    rows = keyed.join(first, ["document_id", "key"]).where("chunk_index > f.chunk_index")
    return rows.select("document_id", "chunk_index", F.col("f.chunk_index").alias("duplicate_of"), repeat_class(F.col("path").eqNullSafe(F.col("f.path")), F.col("content")).alias("class"))


def suppressed(chunks: DataFrame, priority: list[str], least: int = 40, cross_document: bool = False) -> DataFrame:
    """(document_id, chunk_index, kept, kept_chunk): of chunks with the same path and normalised text, the one of the
    label that stands first in `priority`; texts under `least` characters all stay. By default chunks of different
    documents are never the same. chunks: (document_id, chunk_index, label, path, content)."""
    text = F.trim(F.regexp_replace(F.lower(tx.filled(F.col("content"))), r"[ \t\n\r\f\x0B]+", " "))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.coalesce("label", F.lit(""))), F.lit(0)), F.lit(len(priority) + 1))
    rows = chunks.select("document_id", "chunk_index", "path", text.alias("text"), place.alias("place"), F.concat_ws(":", "document_id", "chunk_index").alias("chunk"))
    long, short = rows.where(F.length("text") >= least), rows.where(F.length("text") < least)
    found = kept_first(long, ([] if cross_document else ["document_id"]) + ["path", "text"], ["place", "document_id", "chunk_index"], "chunk")
    out = found.select("document_id", "chunk_index", "kept", F.col("duplicate_of").alias("kept_chunk"))
    return out.union(short.select("document_id", "chunk_index", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("kept_chunk")))


def question_coverage(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, n_needles, n_held, single_chunk, covered): whether the chunks of a question's document hold all of its
    needles, and whether one chunk does. questions: (query_id, document_id, needles); chunks: (document_id, chunk_index,
    content). An equal join by document, and sums; no document is gathered."""
    asked = questions.select("query_id", "document_id", F.transform("needles", lambda n: F.lower(n)).alias("needles"))
    low = F.lower("content")
    held = F.transform("needles", lambda n: F.contains(low, n).cast("int"))
    rows = asked.join(chunks.select("document_id", "content"), "document_id", "left").select("query_id", "needles", F.coalesce(held, F.transform("needles", lambda n: F.lit(0))).alias("held"))
    each = rows.select("query_id", F.size("needles").alias("n"), F.aggregate("held", F.lit(0), lambda a, x: a + x).alias("in_chunk"), F.posexplode_outer("held").alias("i", "h"))
    needle = each.groupBy("query_id", "n", "i").agg(F.max("h").alias("h"), F.max("in_chunk").alias("best"))
    sums = needle.groupBy("query_id", "n").agg(F.coalesce(F.sum("h"), F.lit(0)).alias("held"), F.max("best").alias("best"))
    n = F.greatest("n", F.lit(0))
    return sums.select("query_id", n.alias("n_needles"), F.col("held").alias("n_held"), F.coalesce(F.col("best") == n, F.lit(False)).alias("single_chunk"), (F.col("held") == n).alias("covered"))


def scoped(document_id: Column, document_type: Column, method: Column) -> Column:
    """Whether a chunk is in a question's scope: a document type, where one is given, stands in place of the document,
    and the extraction method narrows either. Nulls ask for nothing."""
    by_type = F.col("document_type") == document_type
    by_document = F.col("document_id") == document_id
    return F.when(document_type.isNotNull(), by_type).when(document_id.isNotNull(), by_document).otherwise(True) & (method.isNull() | (F.col("extraction_method") == method))


def scoped_coverage(questions: DataFrame, chunks: DataFrame, most_ids: int = 3) -> DataFrame:
    """(query_id, n_needles, covered, single_chunk, first_chunks, page_ok, lost, split, passed) of every question.

    questions: (query_id, document_id, document_type, extraction_method, needles, one_chunk, need_page); chunks:
    (chunk_id, document_id, document_type, extraction_method, page_number, content, served). A question is covered if the
    served chunks in its scope (see scoped) hold all its needles together; `lost` tells that only the chunks which are
    not served do. `first_chunks` are the ids, in order, of chunks that hold all alone, at most most_ids; where a page is
    asked for, the first of them must have one. It passes if it is covered, by one chunk where that is asked, and the page
    is there. A question without needles is covered.

    Texts are read once for all needles by anchors.with_hits; a needle found and a question that asks for it meet by an
    equal join, so no question meets a chunk that holds none of its needles. Presence is summed before it is shuffled, and
    the ids are cut to the first ones in each task first. Needles that repeat count once, empty ones hold everywhere."""
    lids = F.array_sort(F.array_distinct(F.transform(F.filter("needles", lambda n: F.coalesce(n, F.lit("")) != ""), lambda n: F.xxhash64(F.lower(n)))))
    scope = [F.col(c).alias(f"q_{c}") for c in ("document_id", "document_type", "extraction_method")]
    q = questions.select("query_id", F.coalesce(lids, F.array().cast("array<bigint>")).alias("need"), F.coalesce("one_chunk", F.lit(False)).alias("one_chunk"), F.coalesce("need_page", F.lit(False)).alias("need_page"), *scope)
    literals = anchors.numbered_literals(questions.select(F.explode("needles").alias("literal")))
    texts = chunks.select("chunk_id", "document_id", "document_type", "extraction_method", "page_number", "served", F.lower(tx.filled(F.col("content"))).alias("low"))
    found = written(anchors.with_hits(texts, "low", literals).drop("low").where(F.size("hits") > 0), "hits")
    met = found.select("*", F.explode("hits").alias("lid")).join(q.select("*", F.explode("need").alias("lid")), "lid")
    met = met.where(scoped(F.col("q_document_id"), F.col("q_document_type"), F.col("q_extraction_method")))
    sums = met.groupBy("query_id", "served", "lid").agg(F.count("*").alias("n")).groupBy("query_id").agg(F.count_if("served").alias("here"), F.count_if(~F.col("served")).alias("away"))
    alone = met.where(F.col("served") & (F.col("lid") == F.col("need")[0]) & (F.size(F.array_except("need", "hits")) == 0)).select("query_id", "chunk_id", "page_number")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    first = alone.withColumn("place", place).where(F.col("place") <= most_ids).groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("first_chunks"), F.min_by("page_number", "place").alias("page"))
    rows = q.select("query_id", F.size("need").cast("long").alias("n_needles"), "one_chunk", "need_page").join(sums, "query_id", "left").join(first, "query_id", "left")
    full = lambda name: F.coalesce(name, F.lit(0)) == F.col("n_needles")
    single = F.col("first_chunks").isNotNull()
    page = ~F.col("need_page") | ~single | F.col("page").isNotNull()
    return rows.select(
        "query_id", "n_needles", full("here").alias("covered"), single.alias("single_chunk"), F.coalesce("first_chunks", F.array().cast(rows.schema["first_chunks"].dataType)).alias("first_chunks"), page.alias("page_ok"),
        (~full("here") & full("away")).alias("lost"), (full("here") & ~single & F.col("one_chunk")).alias("split"), (full("here") & page & (single | ~F.col("one_chunk"))).alias("passed"),
    )


def empty_blocks(blocks: DataFrame) -> DataFrame:
    """(document_id, ord, node_type) of blocks without text."""
    return blocks.where(F.trim(tx.filled(F.col("text"))) == "").select("document_id", "ord", "node_type")


def duplicate_summary(**reports: DataFrame) -> DataFrame:
    """(kind, n_groups, n_items) of several duplicate reports with a column n."""
    rows = [r.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items")) for kind, r in reports.items()]
    return reduce(DataFrame.unionByName, [r.select("kind", "n_groups", "n_items") for r in rows])
