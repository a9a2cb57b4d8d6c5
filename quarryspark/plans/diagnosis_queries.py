"""Registered diagnoses. A vector's expected hits are its next two neighbours by id and its own label among its hits; ten
vectors in a row are a document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus, diagnosis, evaluation
from ..sources.tables import table
from .evaluation_queries import _E, _expected, _hits
from .retrieval_queries import _BASE, bm25, corpus as texts, questions


def _near(spark, root):
    """(query_id, chunk_id): the two vectors with the next ids, whether there are such or not."""
    return _expected(spark, root)[0].select("query_id", F.explode(F.array(F.col("query_id") + 1, F.col("query_id") + 2)).alias("chunk_id"))


def _labelled(spark, root, hits):
    q, v = _expected(spark, root)
    return hits.join(v.select(F.col("vec_id").alias("chunk_id"), "label"), "chunk_id").join(q, "query_id")


def _documents(spark, root, k=20):
    return _hits(spark, root, k).withColumn("document_id", F.floor(F.col("chunk_id") / 10))


def recall_of_all(spark, root):
    """All hits of the own label among the first 20 are required, so the rank is that of the last."""
    hits = _hits(spark, root)
    own = _labelled(spark, root, hits).where("own = label").select("query_id", "chunk_id")
    return diagnosis.recall_of_all(diagnosis.all_ranks(hits.where("rank <= 10"), own, _expected(spark, root)[0]))


def list_metrics(spark, root):
    hits = _hits(spark, root)
    first = evaluation.first_ranks(hits, _near(spark, root), _expected(spark, root)[0])
    return first.select("query_id", diagnosis.listed(F.col("rank")).alias("m")).select("query_id", "m.rank", "m.hit", "m.mrr")


def document_analysis(spark, root):
    q = _expected(spark, root)[0]
    expected = q.select("query_id", F.floor(F.col("query_id") / 10).alias("document_id"))
    return diagnosis.document_analysis(_documents(spark, root, 100), expected, q)


def document_ranks(spark, root):
    return diagnosis.document_ranks(_documents(spark, root))


def document_texts(spark, root):
    """Every document again from its lines that are not blank."""
    lines = corpus.line_chunks(table(spark, root, "documents")).where("trim(content) <> ''")
    return diagnosis.document_texts(lines).select("document_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def missing_expected(spark, root):
    v = table(spark, root, "embeddings").where("label <> 1").select(F.col("vec_id").alias("chunk_id"))
    return diagnosis.missing_expected(_near(spark, root), v)


def mapping_state(spark, root):
    """Each question is expected in the document of its number; that holds it if it has a fifth of its longer words."""
    asked = questions(spark, root).withColumn("chunk_id", F.when(F.col("query_id") % 4 != 3, F.col("query_id")))
    return diagnosis.mapping_state(asked, texts(spark, root), diagnosis.query_overlap(F.col("query"), F.col("text")) >= 0.2)


def competitor_classes(spark, root):
    hits = bm25(spark, root).where("rank <= 10").join(texts(spark, root), "chunk_id")
    kind = diagnosis.competitor_class(F.col("text"), F.col("chunk_id") == F.col("query_id"), ("the ", "der "))
    return hits.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def targeted_diagnosis(spark, root):
    q = _expected(spark, root)[0]
    near = _near(spark, root)
    first = evaluation.first_ranks(_hits(spark, root), near, q).withColumnRenamed("rank", "chunk_rank")
    docs = diagnosis.document_analysis(_documents(spark, root), q.select("query_id", F.floor(F.col("query_id") / 10).alias("document_id")), q).select("query_id", F.col("best_rank").alias("document_rank"))
    rows = first.join(docs, "query_id")
    return rows.select("query_id", diagnosis.targeted(F.col("chunk_rank"), F.col("document_rank"), F.col("query_id") % 3 != 0).alias("diagnosis"))


def _ranks(spark, root):
    """Ranks of the own document's chunks but the query's: as chunks those with an odd id, as documents all; the tenth hit's
    score, and the largest size of a sibling with an even id among the first ten. The vectors are compared once."""
    hits = _documents(spark, root, 100)
    own = F.col("document_id") == F.floor(F.col("query_id") / 10)
    odd, rank = own & (F.col("chunk_id") % 2 == 1), F.col("rank")
    found = hits.groupBy("query_id").agg(
        F.min(F.when(odd, rank)).alias("c"), F.min(F.when(odd, F.struct("rank", "score"))).alias("cs"), F.min(F.when(own, rank)).alias("d"),
        F.max(F.when(rank == 10, F.col("score"))).alias("tenth"), F.max(F.when(own & (rank <= 10) & (F.col("chunk_id") % 2 == 0), F.col("chunk_id") % 100)).alias("largest"),
    )
    return _expected(spark, root)[0].join(found, "query_id", "left")


def vector_causes(spark, root):
    c, d, i = F.col("c"), F.col("d"), F.col("query_id")
    cause = diagnosis.vector_cause(i % 7 != 0, F.when(i % 5 == 0, 2).otherwise(0) + F.when(i % 2 == 0, 1).otherwise(0), c, d, i % 100 == 0, i % 3 == 0)
    return _ranks(spark, root).select("query_id", cause.alias("cause"))


def light_causes(spark, root):
    i = F.col("query_id")
    status = F.when(i % 11 == 0, "corpus_gap").when(i % 13 == 0, "mapping_issue").otherwise("resolved")
    cause = diagnosis.light_cause(status, F.col("c"), F.col("cs.score"), F.col("d"), F.col("tenth"), i % 4 == 0)
    return _ranks(spark, root).select("query_id", cause.alias("x")).select("query_id", "x.cause", "x.confidence")


def unified_causes(spark, root):
    """A vector's size is its number's last two digits; the siblings are the other vectors of its document."""
    i = F.col("query_id")
    rows = _ranks(spark, root)
    cause = diagnosis.unified_cause(i % 7 != 0, F.when(i % 3 == 0, 5).when(i % 11 == 0, 0).otherwise(1), F.col("c"), F.col("d"), F.col("largest"), i % 4 == 0, i % 9 == 0)
    return rows.select("query_id", cause.alias("cause"))


def _failures(spark, root):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(k % 5 == 0, "RETRIEVAL_FAILURE").when(k % 5 == 1, "TOOL_FAILURE").when(k % 5 == 2, "STATE_FAILURE").otherwise("UNLISTED_FAILURE")
    return table(spark, root, "events").select(kind.alias("failure_type"), F.col("user_id").alias("conversation_id"), (k % 7).cast("string").alias("product"), "event_type")


def layer_failures(spark, root):
    return diagnosis.layer_failures(_failures(spark, root))


def failure_representatives(spark, root):
    return diagnosis.representatives(_failures(spark, root), ["event_type"], "conversation_id", "failure_type", "product")


def conversation_behaviour(spark, root):
    """Conversations by the kind of their opening: those whose first turn is long are about leads, short about support."""
    turns = table(spark, root, "conversations")
    n = turns.groupBy("conv_id").agg(F.count_if(F.col("role") == "assistant").alias("retrievals"), F.min_by(F.length("text"), "turn").alias("opening"), F.count_if(F.contains(F.lower("text"), F.lit("the"))).alias("switches"))
    kind = F.when(F.col("opening") >= 400, "LEAD_NEW").when(F.col("opening") < 100, "SUPPORT_ISSUE").otherwise("GENERAL")
    return diagnosis.behaviour(n.withColumn("category", kind), "category", "retrievals", "switches")


def candidates_by_category(spark, root):
    turns = table(spark, root, "conversations")
    n = turns.groupBy("conv_id").agg(F.first("role").alias("r"), F.count("*").alias("n"), F.min("turn").alias("t"))
    return diagnosis.candidates_by(n.select(F.concat(F.lit("n"), F.col("n").cast("string")).alias("category"), (F.col("conv_id") % 3 == 0).alias("candidate")), "category", "candidate")


def regression_checks(spark, root):
    """Whether a question's first hits hold each of its first three words of five letters or more."""
    hits = bm25(spark, root).join(texts(spark, root), "chunk_id")
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z]{5,}"), F.lit(0))), 1, 3)
    return diagnosis.regression(hits, questions(spark, root).select("query_id", words.alias("needles")))


QUERIES = {
    "eval_recall_of_all": recall_of_all, "eval_list_metrics": list_metrics, "eval_document_analysis": document_analysis, "eval_document_ranks": document_ranks, "document_texts": document_texts,
    "eval_missing_expected": missing_expected, "eval_mapping_state": mapping_state, "competitor_classes": competitor_classes, "targeted_diagnosis": targeted_diagnosis, "vector_causes": vector_causes,
    "light_causes": light_causes, "unified_causes": unified_causes, "layer_failures": layer_failures, "failure_representatives": failure_representatives, "conversation_behaviour": conversation_behaviour,
    "candidates_by_category": candidates_by_category, "regression_checks": regression_checks,
}

_NEAR = ", near AS (SELECT query_id, unnest([query_id + 1, query_id + 2]) AS chunk_id FROM q) "
_RANKS = _E + ", own AS (SELECT query_id, min(rank) FILTER (chunk_id % 2 = 1) AS c, arg_min(score, rank) FILTER (chunk_id % 2 = 1) AS cs, min(rank) AS d FROM h WHERE rank <= 100 AND chunk_id // 10 = query_id // 10 GROUP BY 1), ten AS (SELECT query_id, score AS tenth FROM h WHERE rank = 10), z AS (SELECT q.query_id AS i, c, cs, d, tenth FROM q LEFT JOIN own USING (query_id) LEFT JOIN ten USING (query_id)) "
_F = "WITH k AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events), f AS (SELECT CASE k % 5 WHEN 0 THEN 'RETRIEVAL_FAILURE' WHEN 1 THEN 'TOOL_FAILURE' WHEN 2 THEN 'STATE_FAILURE' ELSE 'UNLISTED_FAILURE' END AS failure_type, CASE k % 5 WHEN 0 THEN 60 WHEN 1 THEN 85 WHEN 2 THEN 75 ELSE 0 END AS gravity, user_id AS conversation_id, (k % 7)::VARCHAR AS product, event_type FROM k) "
_LAYERS = "guardrail router query_rewrite retrieval reranker generation grounding state lead support tools final_context".split()
ORACLE_SQL = {
    "eval_recall_of_all": _E + ", w AS (SELECT query_id, count(*) AS n_expected, count(*) FILTER (rank <= 10) AS n_found, max(rank) AS last FROM h WHERE rank <= 20 AND label = own GROUP BY 1), r AS (SELECT q.query_id, coalesce(n_expected, 0) AS n_expected, coalesce(n_found, 0) AS n_found, CASE WHEN n_expected = n_found THEN last END AS rank FROM q LEFT JOIN w USING (query_id)) SELECT *, " + ", ".join(f"CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS recall_at_{k}" for k in (1, 3, 5, 10)) + ", coalesce(1::DOUBLE / rank, 0) AS reciprocal_rank FROM r",
    "eval_list_metrics": _E + _NEAR + ", r AS (SELECT query_id, min(rank) AS rank FROM h JOIN near USING (query_id, chunk_id) WHERE rank <= 20 GROUP BY 1) SELECT q.query_id, rank, coalesce(rank <= 10, false) AS hit, coalesce(round_even(1::DOUBLE / rank, 4), 0) AS mrr FROM q LEFT JOIN r USING (query_id)",
    "eval_document_analysis": _E + ", r AS (SELECT query_id, min(rank) AS best_rank, arg_min(score, rank) AS best_score FROM h WHERE rank <= 100 AND chunk_id // 10 = query_id // 10 GROUP BY 1) SELECT q.query_id, best_rank, best_score, " + ", ".join(f"coalesce(best_rank <= {k}, false) AS in_top_{k}" for k in (10, 20, 50, 100)) + " FROM q LEFT JOIN r USING (query_id)",
    "eval_document_ranks": _E + ", d AS (SELECT query_id, chunk_id // 10 AS document_id, max(greatest(score, 0)) AS score FROM h WHERE rank <= 20 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM d",
    "document_texts": "WITH l AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents), t AS (SELECT document_id, string_agg(content, chr(10) || chr(10) ORDER BY i) AS text FROM l WHERE trim(content) <> '' GROUP BY 1) SELECT document_id, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t",
    "eval_missing_expected": "WITH q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 50 = 0)" + _NEAR + "SELECT DISTINCT query_id, chunk_id FROM near WHERE chunk_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 1)",
    "eval_mapping_state": r"WITH a AS (SELECT item_id AS query_id, CASE WHEN item_id % 4 <> 3 THEN item_id END AS chunk_id, list_distinct(list_filter(string_split_regex(replace(lower(coalesce(text, '')), '?', ''), '[ \t\n\r\f\v]+'), lambda w: length(w) > 3)) AS w FROM benchmark), r AS (SELECT query_id, a.chunk_id, d.text IS NOT NULL AS there, len(w) > 0 AND len(list_filter(w, lambda v: contains(lower(coalesce(d.text, '')), v)))::DOUBLE / len(w) >= 0.2 AS good FROM a LEFT JOIN documents d ON d.doc_id = a.chunk_id) SELECT query_id, (chunk_id IS NOT NULL)::BIGINT AS n_expected, (chunk_id IS NOT NULL AND NOT there)::BIGINT AS n_missing, CASE WHEN chunk_id IS NULL THEN 'corpus_gap' WHEN NOT there OR NOT good THEN 'mapping_issue' ELSE 'resolved' END AS status FROM r",
    "competitor_classes": _BASE + r", x AS (SELECT query_id, chunk_id, coalesce(text, '') AS t, greatest(1, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda w: w <> ''))) AS n FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 10) SELECT CASE WHEN chunk_id = query_id THEN 'CORRECT_KNOWLEDGE' WHEN contains(t, '![') OR (contains(lower(t), '.png') AND n < 40) THEN 'IMAGE_OR_ICON' WHEN contains(lower(t), 'you may also like') THEN 'PRODUCT_CROSS_SELL' WHEN regexp_matches(lower(t), 'customer reviews|write a review|sort by|be the first') THEN 'UI_NOISE' WHEN regexp_matches(lower(t), 'view full details|quantity|sold out|add to cart') THEN 'NAVIGATION' WHEN n < 25 AND length(trim(t)) < 140 THEN 'HEADING_ONLY' WHEN regexp_matches(lower(t), 'investor|prospectus|annual report') THEN 'GENERAL_MARKETING' WHEN regexp_matches(lower(t), 'the |der ') THEN 'RELATED_KNOWLEDGE' ELSE 'UNKNOWN' END AS kind, count(*) AS n FROM x GROUP BY 1",
    "targeted_diagnosis": _E + _NEAR + ", c AS (SELECT query_id, min(rank) AS c FROM h JOIN near USING (query_id, chunk_id) WHERE rank <= 20 GROUP BY 1), d AS (SELECT query_id, min(rank) AS d FROM h WHERE rank <= 20 AND chunk_id // 10 = query_id // 10 GROUP BY 1) SELECT q.query_id, CASE WHEN q.query_id % 3 = 0 THEN 'EXPECTED_CHUNK_NOT_FOUND' WHEN c <= 10 THEN 'DOCUMENT_AND_CHUNK_RETRIEVED' WHEN d <= 20 THEN 'DOCUMENT_RETRIEVED_CHUNK_MISSED' ELSE 'DOCUMENT_NOT_RETRIEVED' END AS diagnosis FROM q LEFT JOIN c USING (query_id) LEFT JOIN d USING (query_id)",
    "vector_causes": _RANKS + "SELECT i AS query_id, CASE WHEN i % 7 = 0 THEN 'CORPUS_GAP' WHEN c <= 10 THEN NULL WHEN i % 5 <> 0 AND i % 2 <> 0 THEN 'EVALUATION_MAPPING' WHEN d IS NULL THEN CASE WHEN i % 100 = 0 THEN 'QUERY_MISMATCH' ELSE 'CORPUS_GAP' END WHEN d <= 10 THEN 'EXPECTED_DOCUMENT_WRONG_CHUNK' WHEN i % 3 = 0 THEN 'RETRIEVAL_COMPETITION' ELSE 'EMBEDDING_REPRESENTATION' END AS cause FROM z",
    "light_causes": _RANKS + ", v AS (SELECT i, CASE WHEN i % 11 = 0 THEN 1 WHEN i % 13 = 0 THEN 2 WHEN c <= 10 THEN 3 WHEN d <= 10 THEN 4 WHEN c BETWEEN 11 AND 30 AND cs >= tenth - 0.015::DOUBLE THEN 5 WHEN i % 4 = 0 AND c IS NULL THEN 6 WHEN d <= 20 AND NOT coalesce(c <= 20, false) THEN 7 WHEN c IS NULL AND d IS NULL THEN 8 ELSE 9 END AS k FROM z) SELECT i AS query_id, ['CORPUS_GAP', 'EVALUATION_MAPPING', 'UNRESOLVED', 'CHUNKING', 'RETRIEVAL_COMPETITION', 'QUERY_MISMATCH', 'CHUNKING', 'UNRESOLVED', 'UNRESOLVED'][k] AS cause, [0.95, 0.9, 0.9, 0.9, 0.85, 0.7, 0.8, 0.55, 0.5][k]::DOUBLE AS confidence FROM v",
    "unified_causes": _RANKS + ", sb AS (SELECT query_id AS i, max(chunk_id % 100) AS l FROM h WHERE rank <= 10 AND chunk_id // 10 = query_id // 10 AND chunk_id % 2 = 0 GROUP BY 1), y AS (SELECT z.*, l FROM z LEFT JOIN sb USING (i)) SELECT i AS query_id, CASE WHEN c <= 10 THEN NULL WHEN i % 7 = 0 THEN 'CORPUS_GAP' WHEN i % 3 <> 0 AND i % 11 = 0 THEN 'EVALUATION_MAPPING' WHEN i % 9 = 0 AND c > 10 THEN 'SUMMARY_MISSING' WHEN d IS NULL THEN 'CORPUS_GAP' WHEN l IS NOT NULL THEN CASE WHEN i % 3 = 0 THEN 'CHUNK_FRAGMENTATION' WHEN l < 40 THEN 'CHUNK_GRANULARITY' ELSE 'EXPECTED_DOCUMENT_WRONG_CHUNK' END WHEN d <= 100 THEN CASE WHEN i % 4 = 0 THEN 'RETRIEVAL_COMPETITION' ELSE 'EMBEDDING_REPRESENTATION' END ELSE 'UNRESOLVED' END AS cause FROM y",
    "layer_failures": _F + f"SELECT layer, CASE layer WHEN 'retrieval' THEN (SELECT count(*) FROM f WHERE gravity = 60) WHEN 'tools' THEN (SELECT count(*) FROM f WHERE gravity = 85) WHEN 'state' THEN (SELECT count(*) FROM f WHERE gravity = 75) ELSE 0 END AS failures FROM (SELECT unnest({_LAYERS}) AS layer)",
    "failure_representatives": _F + ", g AS (SELECT event_type, conversation_id, gravity, product FROM f QUALIFY row_number() OVER (PARTITION BY event_type, conversation_id ORDER BY gravity DESC, product) = 1), a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY gravity DESC, conversation_id) AS pos FROM g), n AS (SELECT *, row_number() OVER (PARTITION BY event_type, product ORDER BY pos) AS nth FROM a) SELECT event_type, conversation_id, product, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN pos <= 3 THEN 0 WHEN nth = 1 THEN 1 ELSE 2 END, pos) AS place FROM n QUALIFY place <= 5",
    "conversation_behaviour": "WITH n AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS r, length(arg_min(text, turn)) AS o, count(*) FILTER (contains(lower(text), 'the')) AS s FROM conversations GROUP BY 1) SELECT sum(r)::BIGINT AS rag_turns, count(*) FILTER (o >= 400) AS lead_conversations, count(*) FILTER (o < 100) AS support_conversations, count(*) FILTER (s > 0) AS product_switch_conversations FROM n",
    "candidates_by_category": "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT 'n' || n AS category, count(*) AS n, count(*) FILTER (conv_id % 3 = 0) AS candidate_failures FROM n GROUP BY 1",
    "regression_checks": _BASE + r", nd AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}')) AS dd, regexp_extract_all(lower(text), '[a-z]{5,}') AS all_w FROM benchmark), w AS (SELECT query_id, list_filter(all_w, lambda v, i: list_position(all_w, v) = i)[:3] AS needles FROM nd), tp AS (SELECT query_id, rank, lower(text) AS t FROM bm JOIN documents ON doc_id = chunk_id WHERE rank <= 10), u AS (SELECT query_id, unnest(needles) AS needle FROM w), hd AS (SELECT query_id, count(*) AS n_needles, count(*) FILTER (EXISTS (SELECT 1 FROM tp WHERE tp.query_id = u.query_id AND contains(t, needle))) AS n_found FROM u GROUP BY 1), lk AS (SELECT query_id, count(*) AS n, coalesce(bool_or(rank <= 3 AND contains(t, 'sha256:')), false) AS leaked FROM tp GROUP BY 1) SELECT w.query_id, coalesce(n_needles, 0) AS n_needles, coalesce(n_found, 0) AS n_found, coalesce(leaked, false) AS leaked, coalesce(n_needles, 0) = coalesce(n_found, 0) AND coalesce(n, 0) > 0 AND NOT coalesce(leaked, false) AS passed FROM w LEFT JOIN hd USING (query_id) LEFT JOIN lk USING (query_id)",
}
