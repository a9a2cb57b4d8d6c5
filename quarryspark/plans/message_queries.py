"""Registered queries of chat messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import messages as ms
from ..sources.tables import table


def message_intents(spark, root):
    """The point of a message is a column of its own, so its long pattern runs once a row."""
    t, p = F.col("text"), F.col("point")
    rows = table(spark, root, "conversations").withColumn("point", ms.without_fillers(t))
    return rows.select("conv_id", "turn", F.sha2("point", 256).alias("point_sha256"), ms.asks_for_knowledge(t, point=p).alias("knowledge"), ms.asks_for_price(t, point=p).alias("price"), ms.is_informational(t, point=p).alias("informational"))


def canonical_questions(spark, root):
    """The benchmark's texts as canonical questions."""
    return table(spark, root, "benchmark").select("item_id", ms.canonical_question(F.col("text")).alias("question"))


QUERIES = {"message_intents": message_intents, "canonical_questions": canonical_questions}


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


# (?i) of the query is of A-Z alone, the SQL engine's of all scripts: tests read `low`, and a prefix is cut by its length.
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_S = ms.SPACE
_T = rf"regexp_replace(coalesce(text, ''), '^{_S}+|{_S}+\z', '', 'g')"
_P = rf"regexp_replace(substring({_T}, length(regexp_extract({_LOW.format(_T)}, '{_q(ms.STRIP.removeprefix('(?i)'))}')) + 1), '{_S}+\z', '')"
_has = lambda pattern: f"regexp_matches(low, '{_q(pattern.removeprefix('(?i)'))}')"
_K = f"(p <> '' AND ({_has(ms.ABOUT_RE)} OR {_has(ms.KNOWLEDGE_RE)}))"
_TRIM = r"regexp_replace({}, '^[ ?.!,;:]+|[ ?.!,;:]+$', '', 'g')"
_TOPIC = _TRIM.format(r"regexp_replace(" + _TRIM.format(rf"regexp_replace(regexp_extract(p, '{_q(ms.ABOUT_RE)}', 1), '\s+', ' ', 'g')") + r", '(?i)\s+(?:" + "|".join(ms.TOPIC_ENDS) + r")\s*$', '')")
ORACLE_SQL = {
    "message_intents": f"SELECT conv_id, turn, sha256(p) AS point_sha256, {_K} AS knowledge, {_has(ms.PRICE_RE)} AS price, {_K} OR {_has(ms.QUESTION_RE)} AS informational FROM (SELECT *, {_LOW.format('p')} AS low FROM (SELECT *, {_P} AS p FROM conversations))",
    "canonical_questions": f"SELECT item_id, CASE WHEN p = '' THEN trim(coalesce(text, '')) WHEN length(topic) >= 2 THEN 'What is ' || topic || '?' ELSE p END AS question FROM (SELECT *, {_TOPIC} AS topic FROM (SELECT *, {_P} AS p FROM benchmark))",
}
