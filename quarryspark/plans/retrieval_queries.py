"""Registered retrieval queries: the benchmark items are the questions, the documents the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import fusion, retrieval
from ..sources.tables import table


def questions(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def vectors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, root, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


#: Lists that the queries of a session share, by application, tables and name.
_MADE: dict[tuple[str, str, str], DataFrame] = {}


def _shared(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A small table on disk: it is made once, and a lost block is made again."""
    key = spark.sparkContext.applicationId, root, name
    if key not in _MADE:
        _MADE[key] = make()
    found = _MADE[key]
    return found if found.is_cached and found.storageLevel != StorageLevel.NONE else found.persist(StorageLevel.DISK_ONLY)


def _counts(spark: SparkSession, root: str) -> DataFrame:
    return _shared(spark, root, "counts", lambda: retrieval.term_counts(questions(spark, root), corpus(spark, root)))


def both(spark, root):
    """The list by BM25 and that by keywords, from one scan of the corpus."""
    found = _shared(spark, root, "lists", lambda: retrieval.lists_topk(questions(spark, root), corpus(spark, root), given=_counts(spark, root)))
    return tuple(found.where(F.col("list") == n).drop("list") for n in (0, 1))


def keyword(spark, root):
    return _shared(spark, root, "keyword", lambda: retrieval.keyword_topk(questions(spark, root), corpus(spark, root)))


def bm25(spark, root):
    return _shared(spark, root, "bm25", lambda: retrieval.bm25_topk(questions(spark, root), corpus(spark, root), given=_counts(spark, root)))


def cosine(spark, root):
    return retrieval.cosine_topk(*vectors(spark, root))


def cosine_filtered(spark, root):
    """The filter stands before the first k: hits of label 0 only."""
    q, v = vectors(spark, root)
    return retrieval.cosine_topk(q, v.where("label = 0"))


def cosine_filtered_after(spark, root):
    """The filter stands behind the first k."""
    q, v = vectors(spark, root)
    return retrieval.cosine_topk(q, v).join(v.where("label = 0").select("chunk_id"), "chunk_id", "left_semi").select("query_id", "chunk_id", "score", "rank")


def pool(spark, root):
    return retrieval.merged(*both(spark, root))


def capped(spark, root):
    return retrieval.capped(pool(spark, root), 30)


def reranked(spark, root):
    return retrieval.reranked_by_idf(capped(spark, root), questions(spark, root), corpus(spark, root)).drop("ord").persist(StorageLevel.DISK_ONLY)


def passthrough(spark, root):
    return retrieval.reranked_passthrough(capped(spark, root)).drop("ord")


def final(spark, root):
    """The whole of it: two lists, merged, capped at 30, reranked, at least 0.2, the first 6."""
    return retrieval.first(retrieval.above(reranked(spark, root), 0.2), 6)


def _by_vectors(spark, root, documents):
    """The whole of it with a list by vectors: those of the documents with the same numbers, asked for by those of the
    questions' numbers; both lists see the same documents."""
    q, v = (table(spark, root, "embeddings").select(F.col("vec_id").alias(name), "embedding") for name in ("query_id", "chunk_id"))
    asked = questions(spark, root)
    near = retrieval.cosine_topk(asked.join(q, "query_id").select("query_id", F.col("embedding").alias("query")), documents.join(v, "chunk_id").select("chunk_id", F.col("embedding").alias("vector")))
    pool = retrieval.capped(retrieval.merged(near, retrieval.keyword_topk(asked, documents)), 30)
    return retrieval.first(retrieval.above(retrieval.reranked_by_idf(pool, asked, documents), 0.2), 6).drop("ord")


def hybrid_by_vectors(spark, root):
    return _by_vectors(spark, root, corpus(spark, root))


def hybrid_filtered(spark, root):
    """English documents only: the filter stands before both lists."""
    docs = table(spark, root, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), "text")
    return _by_vectors(spark, root, docs)


def multi_query(spark, root):
    """Questions with parts: the items whose numbers agree modulo 7 are parts of one."""
    part_of = questions(spark, root).select("query_id", (F.col("query_id") % 7).alias("question_id"))
    return retrieval.best_of_parts(bm25(spark, root), part_of)


def fused(name):
    return lambda spark, root: fusion.fuse(name, *both(spark, root)).select("query_id", "chunk_id", "rank")


QUERIES = {
    "hybrid_by_vectors": hybrid_by_vectors, "hybrid_filtered": hybrid_filtered,
    "keyword_or_topk": keyword, "bm25_topk": bm25, "cosine_topk": cosine, "cosine_topk_filtered": cosine_filtered, "cosine_filter_after_topk": cosine_filtered_after,
    "merge_candidates": pool, "cap_pool": capped, "rerank_lexical_idf": reranked, "rerank_passthrough": passthrough, "hybrid_search_final": final, "multi_query_union_max": multi_query,
    "fusion_rrf": fused("rrf"), "fusion_weighted": fused("weighted"), "fusion_rank_normalized": fused("rank_normalized"), "fusion_current_merge": fused("current_merge"),
}

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BASE = r"""
WITH q AS (SELECT item_id AS query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM benchmark),
d AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS toks FROM documents),
qt AS (SELECT query_id, term, count(*) AS n FROM (SELECT query_id, unnest(toks) AS term FROM q) GROUP BY ALL),
c AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dl AS (SELECT chunk_id, len(toks) AS dl FROM d), av AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
kw0 AS (SELECT query_id, chunk_id, round_even(sum(tf) * 0.1::DOUBLE, 6) AS score FROM c JOIN (SELECT DISTINCT query_id, term FROM qt) USING (term) GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM kw0) WHERE rank <= 20),
bm0 AS (SELECT query_id, chunk_id, round_even(sum(n * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM c JOIN qt USING (term) JOIN df USING (term) JOIN dl USING (chunk_id) CROSS JOIN av GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm0 WHERE score > 0) WHERE rank <= 20),
pool AS (SELECT query_id, chunk_id, bm.score AS vector_score, kw.score AS keyword_score,
  row_number() OVER (PARTITION BY query_id ORDER BY bm.rank NULLS LAST, kw.rank NULLS LAST) AS ord FROM bm FULL JOIN kw USING (query_id, chunk_id)),
cap AS (SELECT query_id, chunk_id, vector_score, keyword_score, CASE WHEN n > 30 THEN place ELSE ord END AS ord FROM (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY greatest(coalesce(vector_score, 0), coalesce(keyword_score, 0)) DESC, ord) AS place FROM pool)
  WHERE n <= 30 OR place <= 30),
own AS (SELECT query_id, chunk_id, n, term, list_contains(toks, term) AS has,
  list_contains(toks, term) OR (term = 'price' AND list_has_any(toks, ['mrp', 'cost'])) OR (term = 'cost' AND list_has_any(toks, ['mrp', 'price'])) OR (term = 'mrp' AND list_has_any(toks, ['price', 'cost'])) AS hit
  FROM (SELECT query_id, chunk_id, count(*) OVER (PARTITION BY query_id) AS n FROM cap) JOIN d USING (chunk_id) JOIN (SELECT DISTINCT query_id, term FROM qt WHERE term NOT IN (""" + _STOP + r""")) USING (query_id)),
wt AS (SELECT *, ln((n + 1)::DOUBLE / (sum(has::INT) OVER (PARTITION BY query_id, term) + 1)) + 1 AS w FROM own),
rr0 AS (SELECT query_id, chunk_id, round_even(sum(CASE WHEN hit THEN w ELSE 0 END) / sum(w), 6) AS rerank_score FROM wt GROUP BY ALL),
rr AS (SELECT query_id, chunk_id, vector_score, keyword_score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, coalesce(vector_score, 0) DESC, coalesce(keyword_score, 0) DESC, chunk_id) AS rank
  FROM cap JOIN rr0 USING (query_id, chunk_id) WHERE rerank_score > 0)
"""
_TOP = "SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({}) QUALIFY rank <= 10"
_COS = """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label, round_even(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 20 {after}
"""
_VEC = ("vec0 AS (SELECT q.vec_id AS query_id, d.chunk_id, round_even(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) + 0.0 AS score FROM d JOIN embeddings e ON e.vec_id = d.chunk_id JOIN embeddings q ON q.vec_id IN (SELECT item_id FROM benchmark)), "
  "vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vec0) WHERE rank <= 20), ")  # fmt: skip
_BY_VECTORS = _BASE.replace("pool AS (SELECT", _VEC + "pool AS (SELECT").replace("bm.score AS vector_score", "vec.score AS vector_score").replace("ORDER BY bm.rank NULLS LAST", "ORDER BY vec.rank NULLS LAST").replace("FROM bm FULL JOIN kw", "FROM vec FULL JOIN kw")
_FINAL = "SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM rr WHERE rerank_score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6"
ORACLE_SQL = {
    "hybrid_by_vectors": _BY_VECTORS + _FINAL, "hybrid_filtered": _BY_VECTORS.replace("AS toks FROM documents)", "AS toks FROM documents WHERE lang = 'en')") + _FINAL,
    "keyword_or_topk": _BASE + "SELECT * FROM kw", "bm25_topk": _BASE + "SELECT * FROM bm", "merge_candidates": _BASE + "SELECT * FROM pool", "cap_pool": _BASE + "SELECT * FROM cap",
    "rerank_lexical_idf": _BASE + "SELECT * FROM rr",
    "rerank_passthrough": _BASE + "SELECT query_id, chunk_id, vector_score, keyword_score, coalesce(vector_score, keyword_score, 0) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(vector_score, keyword_score, 0) DESC, ord) AS rank FROM cap",
    "hybrid_search_final": _BASE + "SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM rr WHERE rerank_score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 6",
    "multi_query_union_max": _BASE + "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id % 7 AS query_id, chunk_id, max(score) AS score FROM bm GROUP BY ALL)",
    "fusion_rrf": _BASE + _TOP.format("SELECT query_id, chunk_id, round_even(sum(1::DOUBLE / (rank + 60)), 9) AS score FROM (SELECT query_id, chunk_id, rank FROM bm UNION ALL SELECT query_id, chunk_id, rank FROM kw) GROUP BY ALL"),
    "fusion_weighted": _BASE + _TOP.format("SELECT query_id, chunk_id, round_even(sum(s * w), 9) AS score FROM (SELECT query_id, chunk_id, w, CASE WHEN hi <= lo THEN 1 ELSE (score - lo) / (hi - lo) END AS s FROM (SELECT *, max(score) OVER (PARTITION BY query_id, w) AS hi, min(score) OVER (PARTITION BY query_id, w) AS lo FROM (SELECT *, 0.7::DOUBLE AS w FROM bm UNION ALL SELECT *, 0.3::DOUBLE FROM kw))) GROUP BY ALL"),
    "fusion_rank_normalized": _BASE + _TOP.format("SELECT query_id, chunk_id, round_even(sum(s * 0.5::DOUBLE), 9) AS score FROM (SELECT query_id, chunk_id, (count(*) OVER (PARTITION BY query_id, l) - rank + 1)::DOUBLE / count(*) OVER (PARTITION BY query_id, l) AS s FROM (SELECT *, 1 AS l FROM bm UNION ALL SELECT *, 2 FROM kw)) GROUP BY ALL"),
    "fusion_current_merge": _BASE + "SELECT query_id, chunk_id, ord AS rank FROM cap WHERE ord <= 10",
    "cosine_topk": _COS.format(where="", after=""), "cosine_topk_filtered": _COS.format(where="WHERE e.label = 0", after=""), "cosine_filter_after_topk": _COS.format(where="", after="AND label = 0"),
}
