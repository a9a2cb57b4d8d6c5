"""Audits of documents, of their pages and trees, and of chunks: issue rows with severities, and verdicts from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from .corpus import kept_first

#: Kinds of source, ways to read them, and states in which a document is served.
SOURCE_TYPES = ("html", "pdf", "scanned_pdf")
METHODS = ("html_parser", "pdf_text", "ocr", "native", "mixed", "docx_native", "doc_native")
LIVE = ("ACTIVE", "VALIDATED")
#: What a page read by OCR should not hold, and a line that only counts pages.
SUSPICIOUS = r"(\|\s*){3,}|\.{4,}"
PAGE_COUNTER = r"(?i)^\s*page\s+[0-9]+\s*(of\s+[0-9]+)?\s*$"


@dataclass(frozen=True)
class Limits:
    giant: int = 5000
    tiny: int = 20
    many_tiny: int = 500
    single: int = 2000
    short_page: int = 50
    low_confidence: float = 50.0


def _found(*rules: tuple[Column, str, str]) -> Column:
    """array of struct(issue, severity) of the rules that hold; a rule that is null does not."""
    return F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for holds, issue, severity in rules]))


def _blank(text: Column) -> Column:
    return ~tx.filled(text).rlike(r"[^ \t\n\r\f\x0B]")


def page_issues(pages: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(document_id, issue, severity, n, first) of pages (document_id, position, page_number, text, by_ocr, confidence);
    positions run from 0 without gaps. Order is judged by each page and the next, met by an equal join on document and
    position, and gaps by counting distinct numbers, so no document's pages are gathered or sorted. Of pages read by
    OCR, short ones, those of low confidence and those with suspicious characters are told too; n counts pages (of missing
    pages the missing ones, of repeated numbers those beyond the first) and `first` is the first page number concerned,
    null where it is the whole document. An empty table gives no row; pages without a number are not judged by it."""
    number, text = F.col("page_number"), tx.filled(F.col("text"))
    own = _found(
        (text == "", "empty page", "WARNING"), (number < 1, "invalid page number", "WARNING"),
        (F.col("by_ocr") & (F.length(text) < limits.short_page), "unusually short page", "WARNING"), (F.col("by_ocr") & (F.col("confidence") < limits.low_confidence), "low OCR confidence", "WARNING"),
        (F.col("by_ocr") & text.rlike(SUSPICIOUS), "suspicious OCR characters", "WARNING"),
    )
    each = pages.select("document_id", number, F.explode(own).alias("i")).groupBy("document_id", "i.issue", "i.severity").agg(F.count("*").alias("n"), F.min("page_number").alias("first"))
    following = pages.select("document_id", (F.col("position") - 1).alias("position"), F.col("page_number").alias("next"))
    falls = pages.select("document_id", "position", "page_number").join(following, ["document_id", "position"]).where("next < page_number")
    falls = falls.groupBy("document_id").agg(F.lit("pages out of order").alias("issue"), F.lit("CRITICAL").alias("severity"), F.count("*").alias("n"), F.min("next").alias("first"))
    numbers = pages.where(number.isNotNull()).groupBy("document_id", "page_number").agg(F.count("*").alias("c"))
    sums = numbers.groupBy("document_id").agg((F.sum("c") - F.count("*")).alias("again"), (F.max("page_number") - F.count_if(number >= 1)).alias("gaps"), F.min(F.when(F.col("c") > 1, number)).alias("twice"))
    confident = pages.where("by_ocr").groupBy("document_id").agg(F.count("*").alias("n"), F.count("confidence").alias("known"))
    nothing = F.lit(None).cast(pages.schema["page_number"].dataType)
    whole = lambda rows, issue, severity, n, first: rows.select("document_id", F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), n.cast("long").alias("n"), first.alias("first"))
    return (
        each.unionByName(falls).unionByName(whole(sums.where("again > 0"), "duplicate page numbers", "WARNING", F.col("again"), F.col("twice")))
        .unionByName(whole(sums.where("gaps > 0"), "missing pages", "CRITICAL", F.col("gaps"), nothing)).unionByName(whole(confident.where("known = 0"), "missing OCR metadata", "INFO", F.col("n"), nothing))
    )


def structure_issues(documents: DataFrame, blocks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(document_id, issue, severity, n): what is wrong with documents' trees as flat blocks (document_id, ord, node_type,
    text). Blocks are judged alone and summed; headings are counted by their small letters first. Documents without a
    block are told too; documents: (document_id)."""
    kind, text = F.col("node_type"), tx.filled(F.col("text"))
    rows = F.size(F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[\s|:\-]+$")))
    paragraph, long = kind == "paragraph", F.length(F.trim(text))
    own = _found(
        (paragraph & _blank(text), "empty paragraph", "WARNING"), (paragraph & (long > limits.giant), "giant paragraph", "WARNING"), ((kind == "list") & _blank(text), "empty list", "WARNING"),
        ((kind == "table") & (rows == 0), "empty table", "WARNING"), ((kind == "table") & (rows == 1), "table with headers but no rows", "WARNING"), ((kind == "heading") & _blank(text), "empty section", "WARNING"),
    )
    each = blocks.select("document_id", F.explode(own).alias("i")).groupBy("document_id", "i.issue", "i.severity").agg(F.count("*").alias("n"))
    heads = blocks.where((kind == "heading") & ~_blank(text)).groupBy("document_id", F.lower("text").alias("head")).agg(F.count("*").alias("c")).where("c > 1")
    sums = blocks.groupBy("document_id").agg(F.count_if(paragraph).alias("paragraphs"), F.count_if(paragraph & ~_blank(text) & (long < limits.tiny)).alias("tiny"), F.sum(F.length(text)).alias("size"))
    whole = lambda rows, issue, severity, n: rows.select("document_id", F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), n.alias("n"))
    one = F.lit(1).cast("long")
    return (
        each.unionByName(heads.groupBy("document_id").agg(F.lit("duplicated section headings").alias("issue"), F.lit("WARNING").alias("severity"), F.count("*").alias("n")))
        .unionByName(whole(sums.where((F.col("paragraphs") == 1) & (F.col("size") > limits.single)), "single giant paragraph structure", "WARNING", one))
        .unionByName(whole(sums.where(F.col("tiny") > limits.many_tiny), "excessive tiny paragraphs", "WARNING", F.col("tiny")))
        .unionByName(whole(documents.select("document_id").join(sums, "document_id", "left_anti"), "document has no structured children", "WARNING", one))
    )


def integrity(website: str = "website", policy: str = "policy") -> Column:
    """array of struct(category, issue, severity) for one document, from the columns document_id, website, policy,
    canonical_url, source_url, source_type, extraction_method, processing_status, version, is_current, content_hash, title,
    text, excluded and exclusion_reason. Documents that are served must be of a target website, not excluded, current
    and with text; excluded ones must say so and why; failed ones of a target website are errors. Nulls count as empty."""
    c, full = F.col, lambda name: tx.filled(F.col(name))
    live, target, excluded = c("processing_status").isin(*LIVE), c(policy) == "TARGET", F.coalesce("excluded", F.lit(False))
    ocr, scanned = c("extraction_method") == "ocr", c("source_type") == "scanned_pdf"
    rules = [
        ("identity", full("document_id") == "", "missing document_id", "ERROR"), ("identity", (full("document_id") != "") & (c("document_id") != urls.document_id(full(website), full("canonical_url"))), "document_id not stable", "ERROR"),
        ("identity", full("canonical_url") == "", "missing canonical_url", "ERROR"), ("identity", full("source_url") == "", "missing source_url", "ERROR"),
        ("identity", (full("source_url") != "") & ~full("source_url").rlike(r"^\s*(?i:https?)://[^/?#\s]+"), "invalid source_url", "ERROR"), ("identity", full(website) != F.lower(full(website)), "website should be lowercase", "ERROR"),
        ("identity", ~full("source_type").isin(*SOURCE_TYPES), "invalid source_type", "ERROR"), ("identity", ~full("extraction_method").isin(*METHODS), "invalid extraction_method", "ERROR"),
        ("version", F.coalesce(c("version") < 1, F.lit(True)), "invalid version number", "ERROR"), ("version", ~full("content_hash").startswith("sha256:"), "invalid content_hash", "ERROR"),
        ("version", live & ~F.coalesce("is_current", F.lit(False)), "production document is not marked is_current", "ERROR"),
        ("domain", live & ~target, "NON_TARGET website cannot be ACTIVE/VALIDATED", "ERROR"), ("exclusion", live & excluded, "excluded document cannot be ACTIVE/VALIDATED", "ERROR"),
        ("exclusion", (c("processing_status") == "EXCLUDED") & ~excluded, "EXCLUDED status but excluded flag not set", "ERROR"), ("exclusion", (c("processing_status") == "EXCLUDED") & (full("exclusion_reason") == ""), "EXCLUDED status missing exclusion_reason", "ERROR"),
        ("status", (c("processing_status") == "FAILED") & target, "FAILED target-domain document must be resolved before freeze", "ERROR"),
        ("content", live & _blank(c("title")), "missing title", "WARNING"), ("content", live & _blank(c("text")), "plain_text is empty", "ERROR"),
        ("ocr", live & ocr & ~scanned, "OCR extraction_method should use scanned_pdf source_type", "WARNING"), ("ocr", live & scanned & ~ocr, "scanned_pdf should use OCR extraction_method", "WARNING"),
    ]
    return F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(category).alias("category"), F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))) for category, holds, issue, severity in rules]))


def verdicts(documents: DataFrame, issues: DataFrame, blocking: tuple[str, ...] = ("ERROR", "CRITICAL")) -> DataFrame:
    """(document_id, errors, warnings, passed) of every document: one with an issue of a blocking severity does not pass.
    Issues are summed by document before they meet the documents."""
    hard = F.col("severity").isin(*blocking)
    sums = issues.groupBy("document_id").agg(F.count_if(hard).alias("errors"), F.count_if(~hard).alias("warnings"))
    n = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return documents.select("document_id").join(sums, "document_id", "left").select("document_id", n("errors"), n("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def chunk_audit(chunks: DataFrame, most: int = 512, broken: Column | None = None) -> DataFrame:
    """(document_id, chunk_index, category): one row for each fault of a chunk. chunks: (document_id, chunk_index, chunk_id,
    content, token_count, path array, content_type, file_hash, version, input_hash, expected_hash). `broken` is a rule of
    the caller for specifications that were torn apart.

    What a chunk repeats is found by hashes, without its text: within a document, a chunk whose content stood before under
    the same path, and one whose content stood before under another id, are each told (both where both hold); an id
    that another row had before, anywhere. Null texts and paths count as empty; an empty table gives no row."""
    content = tx.filled(F.col("content"))
    body = F.regexp_replace(F.element_at(F.split(content, "\n\n"), -1), r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    n_words, n = F.size(tx.words(F.col("body"))), F.col("token_count")
    asks, path = F.col("body").endswith("?"), F.lower(F.array_join("path", " "))
    bars = F.size(F.filter(F.split(content, "\n"), lambda x: F.contains(x, F.lit("|"))))
    lost = lambda name: tx.filled(F.col(name).cast("string")) == ""
    rules = [
        (n > most, "max_token_violation"), ((n <= 8) & (n_words <= 3) & ~F.col("body").rlike("[0-9]"), "orphan_tail"), ((n <= 12) & (n_words <= 6), "heading_only"), (F.col("body").rlike(PAGE_COUNTER), "page_counter"),
        (asks & (n < 40), "faq_question_only"), (F.contains(path, F.lit("faq")) & ~F.contains(F.col("body"), F.lit("?")) & (n < 30), "faq_answer_only"), ((F.col("content_type") == "table") & (bars < 2), "broken_table"),
        (lost("chunk_id") | lost("document_id") | lost("file_hash"), "missing_provenance"), (lost("version"), "missing_provenance"), (~F.col("input_hash").eqNullSafe(F.col("expected_hash")), "nondeterministic_embedding_input"),
    ]
    rules += [] if broken is None else [(broken, "broken_specification")]
    named = chunks.withColumn("body", body)
    own = named.select("document_id", "chunk_index", F.explode(F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in rules]))).alias("category"))
    same = F.sha2(F.lower(F.regexp_replace(content, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")), 256)
    keys = chunks.select("document_id", "chunk_index", "chunk_id", same.alias("content"), F.sha2(F.array_join(F.coalesce("path", F.array()), "|"), 256).alias("path"))
    before = lambda *k: F.lag("chunk_id").over(Window.partitionBy(*k).orderBy("chunk_index"))
    again = keys.withColumn("there", before("document_id", "content", "path")).withColumn("other", before("document_id", "content"))
    again = again.select("document_id", "chunk_index", F.explode(F.array_compact(F.array(*[F.when(holds, F.lit("duplicate_same_context")) for holds in (F.col("there").isNotNull(), F.col("other") != F.col("chunk_id"))]))).alias("category"))
    ids = kept_first(keys.select("document_id", "chunk_index", "chunk_id").where("chunk_id is not null"), ["chunk_id"], ["document_id"], "chunk_index").where("not kept")
    return own.unionByName(again).unionByName(ids.select("document_id", "chunk_index", F.lit("duplicate_chunk_id").alias("category")))
