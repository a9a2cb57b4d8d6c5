"""What comes in: regions that messages name, answers with their sources, uploaded files, older records, extractions of one
document against one another. Each decision is a column expression, so it runs where its rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from .records import resolved_sources

#: Codes and names of regions, the names as they are looked for in a message.
REGION_CODES = {"IN": "IN", "IND": "IN", "US": "US", "USA": "US", "GB": "GB", "UK": "GB", "AU": "AU"}
REGION_NAMES = {
    "INDIA": "IN", "INDIAN": "IN", "UNITED STATES": "US", "USA": "US", "AMERICA": "US", "UNITED KINGDOM": "GB", "BRITAIN": "GB", "ENGLAND": "GB", "AUSTRALIA": "AU",
}
#: What may be uploaded.
UPLOADS = {".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def _of(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def region(text: Column) -> Column:
    """The region that a text is the code or the name of, whatever its case and marks; else null."""
    upper = F.upper(F.trim(tx.filled(text)))
    letters = F.regexp_replace(upper, "[^A-Z]", "")
    name = F.trim(F.regexp_replace(F.regexp_replace(upper, "[^A-Z ]", ""), " +", " "))
    return F.coalesce(_of(REGION_CODES, letters), _of(REGION_NAMES, name))


def region_named(message: Column) -> Column:
    """The region that a message is or names as a word of its own, longer names before shorter ones; else null."""
    found, upper = region(message), F.upper(tx.filled(message))
    for name in sorted(REGION_NAMES, key=lambda n: -len(n)):
        found = F.coalesce(found, F.when(upper.rlike(rf"(?U)\b{name}\b"), REGION_NAMES[name]))
    return found


def source_id(shown: Column) -> Column:
    """The id in what a prompt shows as a source."""
    text = F.trim(tx.filled(shown))
    inner = F.regexp_extract(text, r"(?i)^\[?SOURCE_ID:\s*(.+?)\]?$", 1)
    return F.trim(F.regexp_replace(F.trim(F.when(inner != "", inner).otherwise(text)), r"^[\[\]]+|[\[\]]+$", ""))


def explained(payload: Column, allowed: Column) -> Column:
    """struct(reason, passed, returned, valid, invalid) of an answer as JSON text. It is invalid_json unless it is an
    object, and invalid_answer unless its answer is a text that is not blank; else ok. `returned` are the ids it names, each
    once; a single text counts as a list of one; `valid` those of the allowed ids that they stand for (equal, or the only
    one that begins like it or with which it begins). Null payloads are invalid_json. What is made more than once of the
    payload is parsed once, as the optimizer shares equal expressions."""
    parsed = F.try_parse_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    whole = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    answer = F.coalesce((kind("$.answer") == "STRING") & (F.trim(F.try_variant_get(parsed, "$.answer", "string")) != ""), F.lit(False))
    listed = F.when(F.startswith(kind("$.source_ids"), F.lit("ARRAY")), F.try_variant_get(parsed, "$.source_ids", "array<string>")).when(kind("$.source_ids") == "STRING", F.array(F.try_variant_get(parsed, "$.source_ids", "string")))
    none = F.array().cast("array<string>")
    given = F.coalesce(F.array_distinct(F.transform(F.filter(listed, lambda x: F.trim(F.coalesce(x, F.lit("null"))) != ""), source_id)), none)
    known = F.coalesce(F.filter(F.array_distinct(allowed), lambda a: F.coalesce(a, F.lit("")) != ""), none)
    like = lambda r: F.filter(known, lambda a: F.startswith(a, r) | F.startswith(r, a))
    valid = F.array_distinct(F.array_compact(F.transform(given, lambda r: F.when(F.array_contains(known, r), r).when(F.size(like(r)) == 1, F.try_element_at(like(r), F.lit(1))))))
    ok = whole & answer
    reason = F.when(~whole, "invalid_json").when(~answer, "invalid_answer").otherwise("ok")
    only = lambda a: F.when(ok, a).otherwise(none)
    return F.struct(reason.alias("reason"), ok.alias("passed"), only(given).alias("returned"), only(valid).alias("valid"), only(F.array_except(given, valid)).alias("invalid"))


def answer_sources(explanation: Column, allowed: Column) -> Column:
    """The ids that an explained answer rests on: its valid ones, else all allowed ones in order; null if it is invalid."""
    return F.when(explanation["passed"], resolved_sources(explanation["valid"], allowed))


def upload_issue(name: Column, size: Column, most: int, mime: Column | None = None) -> Column:
    """Why a file is turned away, null if it may come: its name's extension, an empty or too large file, or a kind that
    is neither the extension's nor any application's. A null name or size is a file that is not there."""
    extension = F.lower(F.regexp_extract(tx.filled(name), r"[^./](\.[^./]+)$", 1))
    shown = F.coalesce(mime, _of(UPLOADS, extension)) if mime is not None else _of(UPLOADS, extension)
    return (
        F.when(name.isNull() | size.isNull(), "file not found").when(~extension.isin(*UPLOADS), "unsupported extension").when(size == 0, "file is empty").when(size > most, "file exceeds size limit")
        .when((shown != _of(UPLOADS, extension)) & ~F.startswith(shown, F.lit("application/")), "mime type mismatch")
    )


def legacy_record(url: Column, title: Column, content: Column, content_type: Column) -> Column:
    """struct(canonical_url, website, title, source_type, extraction_method, content_hash) of an older record: HTML unless
    its URL ends in .pdf or is empty and its type says nothing else; papers whose title is marked [OCR] were scanned."""
    address = tx.filled(url)
    page = (F.lower(tx.filled(content_type)) == "html") | ((address != "") & ~F.lower(address).endswith(".pdf"))
    scanned = F.contains(tx.filled(title), F.lit("[OCR]"))
    return F.struct(
        urls.normalised(address).alias("canonical_url"), urls.website(address).alias("website"), F.coalesce(F.nullif(title, F.lit("")), address).alias("title"), F.when(page, "html").when(scanned, "scanned_pdf").otherwise("pdf").alias("source_type"),
        F.when(page, "html_parser").when(scanned, "ocr").otherwise("pdf_text").alias("extraction_method"), tx.content_hash(content).alias("content_hash"),
    )


def best_extractions(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """candidates (key, order, characters, words, score) with the best of each key: most characters, then words, then
    score; of equal ones the first by order. Nulls are worst. A grouped maximum, partly computed before its one shuffle, so
    a key of very many candidates is no one task's."""
    rest = [c for c in candidates.columns if c not in (key, order, "characters", "words", "score")]
    rank = F.struct("characters", "words", "score", (-F.col(order)).alias("_o"), *rest)
    return candidates.groupBy(key).agg(F.max(rank).alias("b")).select(key, (-F.col("b._o")).alias(order), "b.characters", "b.words", "b.score", *[f"b.{c}" for c in rest])
