"""Column functions over text. All stay in the JVM; patterns keep to what RE2 knows too unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALNUM = "[a-z0-9]+"

#: Words that carry no weight in a query.
STOP_WORDS = (
    "a", "about", "an", "and", "are", "can", "could", "does", "for", "hello", "hey", "hi", "how", "i", "in", "is", "just", "know", "like", "me",
    "my", "of", "on", "or", "please", "tell", "the", "to", "u", "us", "want", "we", "what", "would", "you",
)

#: Terms that stand for one another.
SYNONYMS = {"price": ("mrp", "cost"), "cost": ("mrp", "price"), "mrp": ("price", "cost")}


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, with repeats."""
    return F.regexp_extract_all(F.lower(filled(text)), F.lit(ALNUM), F.lit(0))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def query_terms(text: Column, codes: tuple[str, ...] = ()) -> Column:
    """Tokens that are no stop words; repeats stay. The caller's codes are also found behind an article that was glued to
    them: with the code bte, abte is bte."""
    if codes:
        text = F.regexp_replace(filled(text), rf"(?iU)\b(a)({'|'.join(codes)})\b", "$1 $2")
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def lexical_coverage(query: Column, text: Column, codes: tuple[str, ...] = ()) -> Column:
    """The share of a query's distinct terms that a text holds, to six places, a synonym counting as the term; 0 of a
    query without terms."""
    terms, own = F.array_distinct(query_terms(query, codes)), distinct_tokens(text)

    def held(term: Column) -> Column:
        found = F.array_contains(own, term)
        for name, others in SYNONYMS.items():
            found = found | ((term == name) & F.arrays_overlap(own, F.array(*map(F.lit, others))))
        return found

    return F.when(F.size(terms) == 0, 0.0).otherwise(F.bround(F.size(F.filter(terms, held)) / F.size(terms), 6))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(filled(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Four characters a token, rounded up at the third decimal; blank text has none."""
    n = F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(4.0) + F.lit(0.999)))
    return F.when(F.trim(F.regexp_replace(filled(text), r"[ \t\n\r\f\x0B]+", " ")) == "", 0).otherwise(n).cast("long")


def word_count(text: Column, least: int = 0) -> Column:
    """White-space words, at least `least`."""
    return F.greatest(F.size(words(text)), F.lit(least)).cast("long")


def meaningful_characters(text: Column) -> Column:
    """Letters, digits and underscores of any script."""
    return F.length(F.regexp_replace(filled(text), r"[^\p{L}\p{N}_]", "")).cast("long")


def match_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(filled(text)), r"[ \t\n\r\f\x0B]+", " "))


def tidy(text: Column) -> Column:
    """Line ends as one kind, no more than one blank line together, no blanks at line ends or around the text."""
    text = F.regexp_replace(F.regexp_replace(filled(text), "\r\n?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f]+(\n|$)", "$1"), r"^[ \t\n]+|[ \t\n]+$", "")


def without_markup(html: Column) -> Column:
    """HTML without comments, script and style blocks, and tags."""
    html = F.regexp_replace(filled(html), r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    html = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", "")
    return F.regexp_replace(html, r"<[^>]+>", "")


def without_empty_lines_of_markup(text: Column) -> Column:
    """Markdown without lines that hold an image, a linked image or an empty link only."""
    lines = F.split(filled(text), "\n")
    empty = r"^[ \t]*(!\[[^\]]*\]\([^)]+\)|\[!\[[^\]]*\]\([^)]+\)\]\([^)]+\)|\[[ \t]*\]\([^)]+\))[ \t]*$"
    return tidy(F.array_join(F.filter(lines, lambda x: ~x.rlike(empty)), "\n"))


#: What is replaced, in this order.
REDACTIONS = (
    (r"(^|[^A-Za-z0-9])(\+?[0-9][0-9\s\-()]{8,}[0-9])($|[^A-Za-z0-9])", "$1[phone]$3"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]"),
    (r"\bsk-[A-Za-z0-9]{8,}\b", "[api_key]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._\-]+", "[token]"),
    (r"(?i)(authorization\s*:\s*)\S+", "$1[redacted]"),
    (r"(?i)(password\s*[:=]\s*)\S+", "$1[redacted]"),
)


def redacted(text: Column) -> Column:
    """Text without phone numbers, addresses and credentials. The border of a phone number is matched with it, so of two
    numbers one character apart the second stays to the next pass; the pass runs twice."""
    text = filled(text)
    for pattern, new in (REDACTIONS[0], *REDACTIONS):
        text = F.regexp_replace(text, pattern, new)
    return text


#: Marks of a message that is turned away.
INJECTION = ("ignore previous instructions", "ignore all previous", "system prompt", "jailbreak", "developer mode", "reveal your prompt")
ABUSE = ("kill yourself",)


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | F.contains(text, F.lit(mark))
    return found


def guardrail(message: Column, longest: int = 4000) -> Column:
    """The reason to turn a message away, or null."""
    text = F.regexp_replace(filled(message), r"^\s+|\s+$", "")
    low = F.lower(text)
    return F.when(text == "", "empty").when(any_of(low, INJECTION), "prompt_injection").when(any_of(low, ABUSE), "unsupported").when(F.length(text) > longest, "too_long")


def script_language(message: Column) -> Column:
    """hi for Devanagari, hinglish where it mixes with Latin letters, en for Latin, null without letters or for what
    looks like a phone number. A message's hint words are the caller's to add."""
    text = F.regexp_replace(filled(message), r"^\s+|\s+$", "")
    devanagari, latin = F.regexp_count(text, F.lit("[ऀ-ॿ]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(text.rlike(r"^\+?[0-9][0-9\s\-()]{6,}[0-9]$"), None).when((devanagari > 0) & (latin > 0), "hinglish").when(devanagari > 0, "hi").when(latin > 0, "en")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(filled(text), 256))


def last_of(array: Column, n: int) -> Column:
    """The last n elements; all of a shorter array."""
    return F.slice(array, F.greatest(F.lit(1), F.size(array) - n + 1), F.lit(n))


def mobile_number(text: Column) -> Column:
    """A ten-digit mobile number beginning with 6 to 9, after an optional country code 91 or a leading 0; else null."""
    digits = F.regexp_replace(filled(text), "[^0-9]", "")
    return F.nullif(F.regexp_extract(digits, "^(?:0|91)?([6-9][0-9]{9})$", 1), F.lit(""))


def embedding_input(kind: Column, title: Column, path: Column, content: Column) -> Column:
    """Title, kind, the last three parts of the section path, a blank line, and the content."""
    line = lambda name, value: F.when(F.trim(value) != "", F.concat(F.lit(name), F.trim(value)))
    section = F.when(F.size(path) > 0, F.concat(F.lit("Section: "), F.array_join(last_of(path, 3), " > ")))
    head = F.concat_ws("\n", line("Document: ", filled(title)), F.concat(F.lit("Type: "), F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))), section)
    return F.concat(head, F.lit("\n\n"), F.trim(filled(content)))
