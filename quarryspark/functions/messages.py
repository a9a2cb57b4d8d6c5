"""Column functions over chat messages: fillers, questions about knowledge or prices, and their canonical form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled

#: White space, the edge of a word in any script, and the end, written out: engines differ in what \s, \b, a full stop and $ are.
SPACE = r"[ \t\n\x0B\f\r]"
BEFORE, AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|\z)"

#: What a message may begin with before it comes to the point.
FILLERS = (
    r"ok(?:ay)?", "so", "well", "um+", "uh+", "please", "actually", "alright", "right",
    "h+i+", "he+y+", "hell+o+", "hiya", "hello", "hey", "hola", "namaste", "namaskar", "pranam",
    r"how(?:'s| is| are) (?:it going|you|u|ya)(?: doing)?",
)
#: What marks a request for knowledge.
KNOWLEDGE = (
    r"\bwhat is\b", r"\bwhat's\b", r"\bwhat are\b", r"\bwhat should\b", r"\bwhat does\b", r"\bwhat can i\b", r"\bwhat about\b",
    r"\bwho\s+(?:is|are|was|were|founded)\b", r"\bwhere\s+(?:is|are|can|do|does|was)\b", r"\bwhen\s+(?:is|are|do|does|can|was|will)\b", r"\bwhy\b",
    r"\bbenefits?\b", r"\bhow long\b", r"\bhow does\b", r"\bhow do i\b", r"\bhow much\b", r"\bhow about\b", r"\bcost\b", r"\bfeatures?\b", r"\bwarranty\b", r"\bbattery\b",
    r"\bmrp\b", r"\bprice\b", r"\bpricing\b", r"\bspecs?\b", r"\bdelivery\b", r"\bdifference\b", r"\bpolic(?:y|ies)\b", r"\brefund\b", r"\breturn policy\b", r"\bprivacy\b",
    r"\bfounded\b", r"\bfounder\b", r"\bceo\b", r"\btroubleshoot", r"tell(?:\s+me)?(?:\s+more)?\s+about", r"(?:can|could|would)\s+you\s+(?:please\s+)?(?:tell|explain)",
    r"\bexplain\b", r"\bdetails?\b", r"\bdeatils\b", r"\bknow more\b", r"\bmore details?\b", r"\bin details?\b", r"\bdetails of\b", r"\binformation\b", r"\bbluetooth\b",
)
#: What marks a question for a price.
PRICE = (r"\bprice\b", r"\bpricing\b", r"\bmrp\b", r"\bhow much\b", r"\bcost\b")
#: How a request to be told about a topic begins, a question for a fact begins, and a topic may end.
ABOUT = (
    r"i\s+\w+\s+to\s+know\s+(?:more\s+)?about", r"(?:please\s+)?(?:can|could|would)\s+you\s+(?:please\s+)?(?:tell|explain)\s+(?:me\s+)?(?:more\s+)?about",
    r"tell\s+me\s+(?:more\s+)?about", r"what\s+(?:can\s+you\s+)?tell\s+me\s+about",
)
QUESTION = ("who", "what", "where", "when", "why", "which", "how", "is", "are", "was", "were", "does", "do", "did", "can", "could", "would", "should")
TOPIC_ENDS = ("first", "instead", "please", "then", "now", "though")



def plain(pattern: str) -> str:
    """A pattern with \b at its ends and \s outside of classes, with both written out. It takes a character beside the word
    with it, so it is for tests."""
    pattern = re.sub(r"^\\b", lambda _: BEFORE, pattern)
    return re.sub(r"\\b$", lambda _: AFTER, pattern).replace(r"\s", SPACE)


STRIP = r"(?i)^(?:[?!,. \t\n\x0B\f\r]+|(?:" + "|".join(map(plain, FILLERS)) + r")[,!.? \t\n\x0B\f\r]+)+"
ABOUT_RE = r"(?i)^(?:" + "|".join(map(plain, ABOUT)) + rf"){SPACE}+([^\n]+?){SPACE}*\z"


def any_mark(marks: tuple[str, ...]) -> str:
    return "(?i)(?:" + "|".join(map(plain, marks)) + ")"


KNOWLEDGE_RE = any_mark(KNOWLEDGE)
PRICE_RE = any_mark(PRICE)
QUESTION_RE = plain(r"(?i)^(?:please\s+)?(?:also\s+)?(?:and\s+)?(?:" + "|".join(QUESTION) + r")\b")


def without_fillers(message: Column) -> Column:
    """A message without the greetings and small talk that stand before its point, however many. A message of nothing
    else keeps its last filler if no sign follows it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(filled(message), rf"^{SPACE}+|{SPACE}+\z", ""), STRIP, ""), rf"{SPACE}+\z", "")


def asks_for_knowledge(message: Column, marks: tuple[str, ...] = KNOWLEDGE, point: Column | None = None) -> Column:
    """Whether a message asks to be told something, by the caller's marks. `point` is without_fillers(message), where a
    caller has it as a column already."""
    text = without_fillers(message) if point is None else point
    return (text != "") & (text.rlike(ABOUT_RE) | text.rlike(any_mark(marks)))


def asks_for_price(message: Column, marks: tuple[str, ...] = PRICE, point: Column | None = None) -> Column:
    return (without_fillers(message) if point is None else point).rlike(any_mark(marks))


def is_informational(message: Column, marks: tuple[str, ...] = KNOWLEDGE, point: Column | None = None) -> Column:
    text = without_fillers(message) if point is None else point
    return asks_for_knowledge(message, marks, text) | text.rlike(QUESTION_RE)


def canonical_question(message: Column) -> Column:
    """A request about a topic as "What is <topic>?"; any other message without its fillers, or as it is if it has
    nothing else."""
    text = without_fillers(message)
    topic = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, ABOUT_RE, 1), r"\s+", " "), r"^[ ?.!,;:]+|[ ?.!,;:]+$", "")
    topic = F.regexp_replace(F.regexp_replace(topic, r"(?i)\s+(?:" + "|".join(TOPIC_ENDS) + r")\s*$", ""), r"^[ ?.!,;:]+|[ ?.!,;:]+$", "")
    return F.when(text == "", F.trim(filled(message))).when(F.length(topic) >= 2, F.concat(F.lit("What is "), topic, F.lit("?"))).otherwise(text)
