"""Atomic units: the smallest pieces of a document that answer a question on their own. Splitters are tried in order inside
the row, in column functions; the first that finds something decides. Then sizes are enforced: headings alone go, and
what is too long is packed anew from paragraphs and sentences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .structure import held, stripped

#: Numbered questions with their answers, named values, bullets and clauses.
QUESTION = r"(?s)(\d+\.\d+)\s+([^?]+\?)\s+(.+?)(?=\d+\.\d+\s+[^?]+\?|$)"
SPEC = r"(?m)^([A-Za-z][A-Za-z0-9 /\-]+):\s*(.+)$"
BULLET = r"^[-\x{2022}*]\s+(.+)$"
CLAUSE = r"^\d+(\.\d+)+\s+.+"
ATOM = "struct<atom_type:string,path:array<string>,content:string,part:string>"


@dataclass(frozen=True)
class Params:
    """What depends on the corpus: words that make a unit one piece of a kind, all of them or any, in small letters; words
    before a list of benefits; and marks of a product's description."""

    whole_if_all: tuple[tuple[str, tuple[str, ...]], ...] = (("company_information", ("registered office", "corporate office")),)
    whole_if_any: tuple[tuple[str, tuple[str, ...]], ...] = (("contact_information", ("customer support", "contact us", "reach us", "phone", "email")),)
    benefits: tuple[str, ...] = ("why choose", "what makes us better")
    described: tuple[str, ...] = ("Features:", "Why ")
    least_words: int = 40
    least_bullets: int = 3


def _atom(kind: str | Column, path: Column, content: Column, part: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(kind).alias("atom_type"), path.alias("path"), content.alias("content"), lit(part).alias("part"))


def atoms(units: DataFrame, p: Params = Params()) -> DataFrame:
    """(document_id, ord, k, atom_type, path, content, part) of units (document_id, ord, unit_type, path, text), k numbering
    a unit's atoms from 0. Units without text and headings have none; a unit that no splitter takes is one atom of its
    type."""
    text, path = F.col("text"), F.coalesce("path", F.array().cast("array<string>"))
    none = F.array().cast(f"array<{ATOM}>")
    low, own = F.lower(text), stripped(text)
    whole = lambda kind, part="": F.array(_atom(kind, F.col("path"), own, part))
    up = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(QUESTION), F.lit(k)).alias(f"g{k}") for k in (1, 2, 3)])
    answered = F.filter(groups, lambda g: stripped(g["g3"]) != "")
    asked = F.transform(answered, lambda g: _atom("faq_pair", F.concat(up, F.array(F.concat(F.lit("FAQ "), g["g1"]))), F.concat(F.lit("Question: "), stripped(g["g2"]), F.lit("\n\nAnswer: "), stripped(g["g3"])), F.concat(F.lit("faq:"), g["g1"])))
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    bullets = F.transform(F.filter(lines, lambda x: x.rlike(BULLET)), lambda x: stripped(F.regexp_extract(x, BULLET, 1)))
    listed = lambda least: F.when(F.size(bullets) >= least, F.transform(bullets, lambda b, i: _atom("product_feature", F.col("path"), b, F.concat(F.lit("bullet:"), i.cast("string"))))).otherwise(none)
    gains = F.filter(F.transform(F.filter(lines, lambda x: x.rlike(r"^[-\x{2022}*]") | F.contains(x, F.lit("—"))), lambda x: stripped(F.regexp_replace(x, r"^[-\x{2022}*]+", ""))), lambda x: F.size(tx.words(x)) >= 4)
    gained = F.when(F.size(gains) >= 2, F.transform(gains, lambda b, i: _atom("product_feature", F.col("path"), b, F.concat(F.lit("benefit:"), i.cast("string"))))).otherwise(listed(2))
    specs = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(SPEC), F.lit(k)).alias(f"g{k}") for k in (1, 2)])
    named = F.transform(F.filter(specs, lambda g: F.size(tx.words(g["g2"])) >= 2), lambda g: _atom("product_specification", F.col("path"), F.concat(stripped(g["g1"]), F.lit(": "), stripped(g["g2"])), F.concat(F.lit("spec:"), stripped(g["g1"]))))
    rules = [(F.col("unit_type") == "faq_pair", whole("faq_pair")), (F.size(answered) > 0, asked)]
    for kind, words in p.whole_if_all:
        holds = F.lit(True)
        for w in words:
            holds = holds & F.contains(low, F.lit(w))
        rules.append((holds, whole(kind)))
    rules += [(tx.any_of(low, words), whole(kind)) for kind, words in p.whole_if_any]
    rules.append((tx.any_of(low, p.benefits) & (F.size(gained) > 0), gained))
    rules.append(((F.size(specs) >= 2) & (F.size(named) > 0), named))
    described = tx.any_of(own, p.described) | (F.size(tx.words(own)) >= p.least_words)
    rules.append((described & F.coalesce(F.get("path", F.size("path") - 1).rlike(r"\d+\.\d+"), F.lit(False)), whole("product_description")))
    rules += [(F.col("unit_type") == "clause", whole("policy_clause")), (F.size(bullets) >= p.least_bullets, listed(p.least_bullets))]
    found = whole(F.when(F.col("unit_type") == "semantic", "paragraph").otherwise(F.col("unit_type")))
    for holds, value in reversed(rules):
        found = F.when(F.coalesce(holds, F.lit(False)), value).otherwise(found)
    rows = units.select("document_id", "ord", "unit_type", path.alias("path"), tx.filled(text).alias("text")).where((stripped(F.col("text")) != "") & (F.coalesce("unit_type", F.lit("")) != "heading"))
    return held(rows, _atoms=found).select("document_id", "ord", F.posexplode("_atoms").alias("k", "a")).select("document_id", "ord", "k", "a.*")


def heading_only(content: Column) -> Column:
    """Whether a text is a heading without a body: at most 12 tokens, no end of a sentence, and words that begin in capitals
    and go on in small letters, or a clause's number."""
    own = stripped(content)
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    title = ~own.rlike(rf"(^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}") & ~own.rlike(rf"{cased}\p{{Lu}}")
    return (own == "") | ((tx.token_estimate(own) <= 12) & ~own.rlike(r"[.?!]$") & (title | own.rlike(CLAUSE)))


def _packed(text: Column, target: int, most: int) -> Column:
    """Parts of a text, packed from paragraphs up to `target` tokens; a paragraph beyond `most` from its sentences."""
    joined = lambda a, sign, b: F.when(a == "", b).otherwise(F.concat(a, F.lit(sign), b))
    closed = lambda s: F.when(s["now"] != "", F.concat(s["parts"], F.array(s["now"]))).otherwise(s["parts"])
    state = lambda parts, now: F.struct(parts.alias("parts"), now.alias("now"))

    def step(sign: str, beyond):
        def add(s: Column, x: Column) -> Column:
            both = joined(s["now"], sign, x)
            return F.when(tx.token_estimate(both) <= target, state(s["parts"], both)).otherwise(beyond(closed(s), x))

        return add

    by_sentence = lambda parts, x: F.aggregate(F.split(x, r"(?<=[.!?])\s+"), state(parts, F.lit("")), step(" ", state))
    by_paragraph = step("\n\n", lambda parts, x: F.when(tx.token_estimate(x) <= most, state(parts, x)).otherwise(by_sentence(parts, x)))
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), stripped), lambda x: x != "")
    return F.aggregate(paragraphs, state(F.array().cast("array<string>"), F.lit("")), by_paragraph, closed)


def enforced(found: DataFrame, target: int = 350, most: int = 512) -> DataFrame:
    """atoms() of at most `most` tokens where their paragraphs or sentences allow it: longer ones are packed anew, in the
    order of their parts (`part` then ends in split:k); headings alone go. A sentence longer than that stays whole."""
    own = stripped(F.col("content"))
    parts = F.when(tx.token_estimate(own) <= most, F.array(F.col("content"))).otherwise(_packed(own, target, most))
    rows = held(found.where(~heading_only(F.col("content"))), _parts=parts).select("*", F.posexplode("_parts").alias("_i", "_part"))
    split = F.when(F.size("_parts") > 1, F.concat_ws("/", F.nullif("part", F.lit("")), F.concat(F.lit("split:"), F.col("_i").cast("string")))).otherwise(F.col("part"))
    return rows.where(~heading_only(F.col("_part"))).select("document_id", "ord", "k", F.col("_i").alias("i"), "atom_type", "path", F.col("_part").alias("content"), split.alias("part"), tx.token_estimate(F.col("_part")).alias("token_count"))
