"""Decisions about pages, documents and chunks: what belongs to the corpus, what kind it is, what must be looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .corpus import first_that

BLANK = r"[ \t\n\r\f\x0B]+"

#: Reasons to leave a page out of the corpus, and document types.
NON_TARGET, NOT_REQUIRED, CART, THIRD_PARTY, NOT_FOUND = "non-target website", "not_required_for_production_kb", "cart/checkout page", "third-party app embed", "404 page"
POLICY_SLUGS = ("terms", "privacy", "return", "warranty", "policy", "shipping", "refund")
POLICY_TITLES = ("terms & conditions", "privacy policy", "return", "warranty")
FAQ_MARKS = ("faq", "frequently asked")
NOTICE_PARTS = ("notice", "agenda", "outcome", "pre-intimation", "/gm/", "/bt/", "/notices/")
#: What OCR leaves behind, and texts that are only part of a page's surface.
OCR_GARBAGE = r"([^\n])\1{4,}|[^a-zA-Z0-9 \t\n\r\f\x0B.,;:!?()\-–—/₹$%@&'\"]{3,}"
UI_ONLY = (r"(?i)click the map to enable", r"(?i)^send message\n?$", r"(?i)^message us\n?$", r"(?i)^drop us message")
CHUNK_UI = ("page ", "you may also like", "add to cart", "write a review", "sort by")
LEAKED = ("embedding_version:", "chunk_id:", "document_version:")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(tx.filled(text), rf"^{BLANK}|{BLANK}$", "")


def website_policy(website: Column, targets: tuple[str, ...]) -> Column:
    """TARGET for the named websites, whatever their case and with or without www., else NON_TARGET."""
    return F.when(F.regexp_replace(F.lower(website), r"^www\.", "").isin(*targets), "TARGET").otherwise("NON_TARGET")


def exclusion(policy: Column, url: Column, title: Column, text: Column, not_required: tuple[str, ...] = ()) -> Column:
    """Why a page does not belong to the corpus; null if it does. Only the first 500 characters are searched for a
    not-found notice, as that stands at a page's top."""
    low = F.lower(url)
    has = lambda of, mark: F.contains(of, F.lit(mark))
    return first_that(
        (policy != "TARGET", NON_TARGET), (url.isin(*not_required) if not_required else F.lit(False), NOT_REQUIRED), (has(low, "/cart") | has(low, "/checkout"), CART), (has(low, "/apps/"), THIRD_PARTY),
        (has(F.lower(title), "404") | has(F.lower(title), "not found") | has(F.lower(F.substring(tx.filled(text), 1, 500)), "page not found"), NOT_FOUND),
    )


def faq_structure(title: Column, headings: Column, paragraphs: Column | None = None) -> Column:
    """Whether the title, a heading, or the beginning of a paragraph says that it is a list of questions."""
    found = tx.any_of(F.lower(tx.filled(title)), FAQ_MARKS) | F.exists(headings, lambda h: tx.any_of(F.lower(h), FAQ_MARKS))
    return found | F.exists(paragraphs, lambda p: F.upper(F.trim(p)).startswith("FAQ")) if paragraphs is not None else found


def document_type(url: Column, title: Column, source_type: Column, faq: Column, product_parts: tuple[str, ...] = (), product_words: tuple[str, ...] = ()) -> Column:
    """The kind of a document by its URL, title and structure. URL parts and words of products are the caller's."""
    low, name = F.lower(url), F.lower(title)
    part = lambda mark: F.contains(low, F.lit(mark))
    pdf = source_type.isin("pdf", "scanned_pdf")
    return first_that(
        (part("/products/"), "product"), ((part("/pages/") & tx.any_of(low, POLICY_SLUGS)) | tx.any_of(name, POLICY_TITLES), "policy"), (faq | part("faq"), "faq"),
        (part("/blog/") | F.contains(name, F.lit("blog")), "blog"), (part("/investor/") & tx.any_of(low, NOTICE_PARTS), "notice"), (part("/investor/"), "investor"),
        (tx.any_of(low, product_parts) | (pdf & tx.any_of(low, product_words)), "product"), (pdf, "other"), (source_type == "html", "webpage"), (F.lit(True), "other"),
    )


def letter_shares(text: Column) -> Column:
    """For each line that is not blank, the share of letters in it."""
    lines = F.filter(F.transform(F.split(tx.filled(text), r"\r\n|[\n\r\f\x0B]"), _stripped), lambda s: s != "")
    return F.transform(lines, lambda s: F.regexp_count(s, F.lit(r"\p{L}")) / F.length(s))


def _below(shares: Column, least: float) -> Column:
    return F.size(F.filter(shares, lambda x: x < least))


def garbage_signals(text: Column) -> Column:
    """Runs of one character five times or more, and of three or more characters that no prose holds."""
    return F.regexp_count(tx.filled(text), F.lit(OCR_GARBAGE))


def ocr_concern(text: Column) -> Column:
    """Whether a text read by OCR is doubtful: garbage, no or mostly short words, or lines of few letters."""
    words = F.regexp_extract_all(tx.filled(text), F.lit("[A-Za-z]{2,}"), F.lit(0))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 2))
    return (_stripped(text) != "") & ((garbage_signals(text) >= 2) | (F.size(words) == 0) | (short > 0.25 * F.size(words)) | (_below(letter_shares(text), 0.45) >= 3))


def ocr_corrupted(text: Column) -> Column:
    """Whether it is too corrupt to use unseen."""
    few_words = (F.length(tx.filled(text)) > 400) & (F.regexp_count(tx.filled(text), F.lit("[A-Za-z]{3,}")) < 25)
    return (_stripped(text) != "") & ((garbage_signals(text) >= 3) | (_below(letter_shares(text), 0.35) >= 5) | few_words)


def ocr_grade(text: Column) -> Column:
    """UNUSABLE, SUBSTANTIAL (errors), MINOR or GOOD."""
    n = garbage_signals(text)
    few_words = (F.length(tx.filled(text)) > 400) & (F.regexp_count(tx.filled(text), F.lit("[A-Za-z]{3,}")) < 25)
    return first_that((_stripped(text) == "", "UNUSABLE"), (n >= 6, "UNUSABLE"), (n >= 4, "SUBSTANTIAL"), (n >= 1, "MINOR"), (few_words, "UNUSABLE"), (F.lit(True), "GOOD"))


def low_value(text: Column, override: Column | None = None, least: int = 100) -> Column:
    """struct(tokens, classification, reason) of a text of fewer than `least` words; null for longer ones. An override
    by hand comes first."""
    n = tx.word_count(text)
    hits = sum((tx.filled(text).rlike(p).cast("int") for p in UI_ONLY), F.lit(0))
    pick = lambda kind, reason: F.struct(n.alias("tokens"), F.lit(kind).alias("classification"), F.lit(reason).alias("reason"))
    found = F.when(hits >= 2, pick("NOT_USEFUL", "Content is primarily UI placeholders")).otherwise(pick("REVIEW", "Short document requires manual usefulness review"))
    if override is not None:
        found = F.when(override.isNotNull(), F.struct(n.alias("tokens"), override.alias("classification"), F.lit("override").alias("reason"))).otherwise(found)
    return F.when(n < least, found)


def after_low_value(status: Column, classification: Column) -> Column:
    """An eligibility status after a decision on low value; null decisions change nothing."""
    return F.when(classification == "NOT_USEFUL", "EXCLUDED").when(classification == "REVIEW", "REVIEW").otherwise(status)


def review_decision(url: Column, text: Column, kind: Column, by_ocr: Column, scope: str, ambiguous: tuple[str, ...] = (), review_reason: Column | None = None) -> Column:
    """struct(decision, confidence, reason, evidence) for a document under review. `scope` is the caller's pattern of what is
    in scope, `ambiguous` URLs that only a person can judge, a closing slash aside; `review_reason` why it is under review."""
    n = F.length(F.regexp_replace(tx.filled(text), BLANK, ""))
    ocr, signals = F.coalesce(by_ocr, F.lit(False)), garbage_signals(text)
    grade = F.when(ocr, ocr_grade(text)).otherwise("GOOD")
    said = tx.filled(text).rlike(scope)
    in_scope = kind.isin("investor", "notice", "policy", "product") | said
    known = F.rtrim(url, F.lit("/")).isin(*[u.rstrip("/") for u in ambiguous]) if ambiguous else F.lit(False)
    shown = lambda **parts: F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in parts.items()])
    out = lambda decision, confidence, reason, evidence: F.struct(F.lit(decision).alias("decision"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), F.lit(reason).alias("reason"), evidence.alias("evidence"))
    why = review_reason if review_reason is not None else F.lit(None).cast("string")
    return first_that(
        (known, out("KEEP_REVIEW", "high", "Document type and production RAG relevance remain uncertain", F.concat(shown(type=kind, meaningful_chars=n), F.lit(", url is ambiguous")))),
        (grade == "UNUSABLE", out("KEEP_REVIEW", "high", "OCR grade UNUSABLE — content not reliably readable for retrieval", shown(ocr_grade=grade, garbage_signals=signals, meaningful_chars=n))),
        (grade == "SUBSTANTIAL", out("KEEP_REVIEW", "high", "OCR grade SUBSTANTIAL — errors may materially affect retrieval accuracy", shown(ocr_grade=grade, garbage_signals=signals))),
        ((kind == "other") & ~in_scope & (n < 500), out("KEEP_REVIEW", "medium", "Ambiguous relevance with insufficient in-scope signals", shown(type=kind, meaningful_chars=n, in_scope_keywords=said))),
        ((n >= 200) & in_scope, out("APPROVE", F.when(grade == "GOOD", "high").otherwise("medium"), "Content is meaningful, in-scope, and sufficiently readable for retrieval", shown(type=kind, ocr_grade=grade, meaningful_chars=n, review_reason=why))),
        (F.lit(True), out("KEEP_REVIEW", "low", "Insufficient evidence to approve or reject automatically", shown(type=kind, meaningful_chars=n, in_scope=in_scope))),
    )


def after_review(status: Column, decision: Column) -> Column:
    """An eligibility status after the review of a document; documents that stay under review keep theirs."""
    return F.when(decision == "APPROVE", "ELIGIBLE").when(decision == "REJECT", "EXCLUDED").otherwise(status)


def validated(cleaned: Column, baseline: Column, title: Column, url: Column, source_type: Column, excluded: Column) -> Column:
    """struct(status, errors, warnings) of a document: what was cleaned against the text it was cleaned from. Excluded
    documents pass as they are; errors fail, warnings leave VALIDATED, neither makes it ACTIVE."""
    n, before = tx.meaningful_characters(cleaned), tx.meaningful_characters(baseline)
    pdf, html = source_type.isin("pdf", "scanned_pdf"), source_type == "html"
    sparse = pdf & (before < 150)
    share = F.when(~sparse & (before > 0), n / before)
    some = lambda *rules: F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in rules]))
    left = [(F.contains(tx.filled(cleaned), F.lit(m)), f"remaining: {m}") for m in ("Your cart is empty", "### Quick Links", "Become Our Partner", "[Judge.me]")]
    errors = some(
        (_stripped(cleaned) == "", "empty"), (tx.filled(url) == "", "missing source_url"), (~(pdf | html), "invalid source_type"), (html & (n < 80), "too short"), (share < 0.5, "excessive loss"),
    )
    warnings = some((_stripped(title) == "", "missing title"), (sparse & (n < 30), "sparse extraction"), ((share >= 0.5) & (share < 0.7), "high reduction"), *left)
    status = F.when(excluded, "EXCLUDED").when(F.size(errors) > 0, "FAILED").when(F.size(warnings) > 0, "VALIDATED").otherwise("ACTIVE")
    return F.struct(status.alias("status"), F.when(~excluded, errors).alias("errors"), F.when(~excluded, warnings).alias("warnings"))


def downstream_eligible(policy: Column, status: Column) -> Column:
    """Whether a document goes on to chunking."""
    return (policy == "TARGET") & status.isin("ACTIVE", "VALIDATED")


def exclusion_issues(policy: Column, status: Column, excluded: Column, reason: Column, known: tuple[str, ...]) -> Column:
    """What contradicts itself in a document's status and its mark of exclusion."""
    out = (status == "EXCLUDED") | excluded
    live = status.isin("ACTIVE", "VALIDATED")
    return F.array_compact(F.array(
        F.when(excluded & (status != "EXCLUDED"), "metadata.excluded set but status is not EXCLUDED"), F.when(out & (tx.filled(reason) == ""), "missing exclusion_reason"),
        F.when(out & (tx.filled(reason) != "") & ~reason.isin(*known), "unknown exclusion_reason"), F.when(live & (policy != "TARGET"), "NON_TARGET document has production status"),
        F.when(live & excluded, "excluded metadata on ACTIVE/VALIDATED document"),
    ))


def chunk_issues(content: Column, tokens: Column, most: int = 512, **ids: Column) -> Column:
    """The names of what is wrong with a chunk; `ids` are columns that must not be empty."""
    own, low = _stripped(content), F.lower(tx.filled(content))
    letters = F.regexp_count(own, F.lit(r"\p{L}")) / F.greatest(F.length(own), F.lit(1))
    garbage = (own == "") | ((F.length(own) < 4) & own.rlike(r"^[^a-zA-Z0-9]{0,5}$")) | ((letters < 0.15) & (F.length(own) > 20))
    rules = [(own == "", "empty_content"), (tokens <= 0, "invalid_token_count"), (tokens > most, "token_limit_exceeded")]
    rules += [(tx.filled(c.cast("string")) == "", f"missing_{name}") for name, c in ids.items()]
    rules += [(F.contains(low, F.lit(mark)), "forbidden_metadata_leakage") for mark in LEAKED]
    rules += [(garbage, "ocr_garbage"), ((F.length(own) < 120) & tx.any_of(F.lower(own), CHUNK_UI), "ui_debris")]
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in rules]))


def quality_gate(chunks: DataFrame, issues: Column, small: int = 25) -> DataFrame:
    """One row: how many chunks there are, pass, fail and are small, and their largest and mean token count. Sums only,
    so tasks add up their own rows first."""
    rows = chunks.select("token_count", (F.size(issues) > 0).alias("failed"))
    n = rows.agg(F.count("*").alias("generated"), F.count_if("failed").alias("n_failed"), F.count_if(F.col("token_count") < small).alias("n_small"), F.max("token_count").alias("most"), F.bround(F.avg("token_count"), 4).alias("mean"))
    return n.select("generated", (F.col("generated") - F.col("n_failed")).alias("n_passed"), "n_failed", "n_small", "most", "mean", F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL").alias("determinism"))


def embeddable(status: Column) -> Column:
    """Null for a chunk that may be embedded, else why it is turned away."""
    return F.when(status == "REVIEW", "REVIEW chunk rejected").when(status == "DO_NOT_EMBED", "DO_NOT_EMBED chunk rejected").when(F.coalesce(status != "EMBED_READY", F.lit(True)), "invalid eligibility status")


def set_issues(chunks: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(issue, key, n): ids and inputs that stand for several chunks of a set."""
    found = lambda issue, key: chunks.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(issue).alias("issue"), "key", "n")
    return found("duplicate_chunk_ids", id_col).union(found("duplicate_chunks", hash_col))


def extraction_quality(pages: Column, characters: Column, words: Column, blocks: Column, image_share: Column) -> Column:
    """struct(score, poor): 0 to 100 from characters, words and blocks a page, less for images; poor if much of the
    content was likely missed."""
    chars, own = characters / pages, words / pages
    least = lambda x: F.least(x, F.lit(1.0))
    penalty = F.when(chars < 150, 10.0 * image_share).otherwise(0.0)
    score = 50.0 * least(chars / 500.0) + 30.0 * least(own / 80.0) + 10.0 * least(blocks / F.greatest(3 * pages, F.lit(1))) - penalty
    poor = (chars < 150) | ((image_share >= 0.10) & (chars < 300)) | ((image_share >= 0.25) & (own < 20))
    none = (pages == 0) | (characters == 0)
    return F.struct(F.when(pages == 0, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 4)).alias("score"), F.coalesce(none | poor, F.lit(True)).alias("poor"))


def extraction_issues(text: Column, n_units: Column, least: int = 40, garbage: float = 0.15, **ids: Column) -> Column:
    """What is wrong with an extracted document: no units, no or little text, hardly a letter in it, or missing ids."""
    own = _stripped(text)
    letters = F.regexp_count(own, F.lit(r"\p{L}")) / F.greatest(F.length(own), F.lit(1))
    rules = [(n_units == 0, "empty_extraction"), (own == "", "empty_text"), ((own != "") & (F.length(own) < least), "below_min_text_threshold"), ((letters < garbage) & (F.length(own) > 20), "excessive_garbage")]
    rules += [(tx.filled(c.cast("string")) == "", f"missing_{name}") for name, c in ids.items()] + [((n_units > 0) & (own == ""), "structure_missing")]
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name in rules]))


def chunk_problems(chunks: DataFrame, most: int = 512) -> DataFrame:
    """(category, severity, n): empty and oversized chunks, ids that several chunks have, and contents that repeat within
    a document, counted. chunks: (chunk_id, document_id, content, token_count, method)."""
    over = (F.col("token_count") > most) & (F.col("method") != "hard")
    own = chunks.agg(F.count_if(_stripped(F.col("content")) == "").alias("empty_content"), F.count_if(F.col("token_count") <= 0).alias("invalid_token_count"), F.count_if(over).alias("token_limit_exceeded"))
    own = own.select(F.explode(F.create_map(*[x for c in own.columns for x in (F.lit(c), F.col(c))])).alias("category", "n")).select("category", F.lit("P1").alias("severity"), "n")
    again = lambda name, severity, *keys: chunks.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n")).select(F.lit(name).alias("category"), F.lit(severity).alias("severity"), "n")
    content = F.sha2("content", 256).alias("content_hash")
    return own.union(again("duplicate_chunk_id", "P0", "chunk_id")).union(again("duplicate_content", "P2", "document_id", content))
