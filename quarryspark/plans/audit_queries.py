"""Registered audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, corpus, evaluation
from ..sources.tables import table
from .corpus_queries import _EST, _LINES, _U, _urls

#: What the audit of boilerplate looks for.
BOILERPLATE = {"rights": r"(?i)all rights reserved", "license": r"(?i)licen[sc]ed? ", "address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "repeated_mark": r"[#*%&$]{3}"}


def chunk_bands(spark, root):
    return audit.bands(corpus.line_chunks(table(spark, root, "documents")), "token_count")


def corpus_cross_tab(spark, root):
    return audit.cross_tab(table(spark, root, "documents"), "lang", "source")


def identity_integrity(spark, root):
    return audit.identity_issues(_urls(spark, root), "page_id", "normalised", "url")


def turn_numbering(spark, root):
    """Turns of each role, whose numbers have gaps where others spoke."""
    turns = table(spark, root, "conversations").select(F.concat_ws(":", "conv_id", "role").alias("speaker"), "turn")
    return audit.numbering_gaps(turns, "speaker", "turn")


def boilerplate_scan(spark, root):
    return audit.pattern_hits(table(spark, root, "documents"), BOILERPLATE)


def sticky_language(spark, root):
    """The language of the last turn so far that has one."""
    rows = audit.sticky(table(spark, root, "conversations"), "conv_id", "turn", tx.script_language(F.col("text")), "none")
    return rows.select("conv_id", "turn", F.col("sticky").alias("language"))


def token_distribution(spark, root):
    rows = table(spark, root, "documents").select("lang", tx.token_estimate(F.col("text")).cast("double").alias("tokens"))
    return evaluation.nearest_rank(rows, "tokens", (50, 90, 95, 99), "lang")


QUERIES = {
    "chunk_bands": chunk_bands, "corpus_cross_tab": corpus_cross_tab, "identity_integrity": identity_integrity, "turn_numbering": turn_numbering, "boilerplate_scan": boilerplate_scan,
    "sticky_language": sticky_language, "token_distribution": token_distribution,
}

_HITS = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS pattern, len(regexp_extract_all(text, '{p}'))::INT AS n, length(regexp_extract(text, '(?s)^(.*?)' || '{p}', 1)) + 1 AS first FROM documents WHERE regexp_matches(text, '{p}')" for name, p in BOILERPLATE.items())
_T = "SELECT lang, (" + _EST.format("text") + ")::DOUBLE AS tokens FROM documents"
ORACLE_SQL = {
    "chunk_bands": _LINES.rstrip(", ") + " SELECT count(*) FILTER (token_count < 30) AS under, count(*) FILTER (token_count BETWEEN 30 AND 150) AS within, count(*) FILTER (token_count > 150) AS over, round_even(avg(token_count), 2) AS mean, median(token_count)::DOUBLE AS median, max(token_count) AS most FROM n0",
    "corpus_cross_tab": "WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents) SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n FROM d GROUP BY CUBE (lang, source)",
    "identity_integrity": _U + ", g AS (SELECT normalised AS key, count(*) AS n, count(DISTINCT url) AS urls FROM u GROUP BY 1) SELECT 'duplicate_identity' AS issue, key, n FROM g WHERE n > 1 UNION ALL SELECT 'normalisation_collision', key, n FROM g WHERE urls > 1",
    "turn_numbering": "SELECT * FROM (SELECT concat_ws(':', conv_id, role) AS speaker, (max(turn) + 1 - count(DISTINCT turn))::INT AS missing, count(*) - count(DISTINCT turn) AS repeated FROM conversations GROUP BY 1) WHERE missing > 0 OR repeated > 0",
    "boilerplate_scan": _HITS,
    "sticky_language": r"WITH l AS (SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^\+?[0-9][0-9\s\-()]{6,}[0-9]$') THEN NULL WHEN regexp_matches(t, '[ऀ-ॿ]') AND regexp_matches(t, '[A-Za-z]') THEN 'hinglish' WHEN regexp_matches(t, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' END AS v FROM (SELECT *, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM conversations)) SELECT conv_id, turn, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'none') AS language FROM l",
    "token_distribution": "SELECT lang, count(*) AS n, " + ", ".join(f"round_even((list(tokens ORDER BY tokens))[round_even({p / 100}::DOUBLE * (count(*) - 1), 0)::INT + 1], 3) AS p{p}" for p in (50, 90, 95, 99)) + f" FROM ({_T}) GROUP BY 1",
}
