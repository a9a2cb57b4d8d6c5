"""Registered queries of the fuzzy dictionary: the parts are the catalogue, and words are theirs with letters put wrong, and
those of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzzy
from ..sources.tables import table

FIXES = (("warrenty", "warranty", 0.95, False), ("wanna", "want to", 0.95, False), ("widgit", "widget", 0.96, True))


def _names(spark, root):
    """(name, place): the distinct names of the parts, in their order."""
    names = table(spark, root, "part").select(F.col("p_name").alias("name")).union(table(spark, root, "part").select("p_type")).distinct()
    return names.select("name", (F.length("name") * 1000 + F.ascii(F.substring("name", 2, 1)) * 3 + F.ascii(F.substring("name", -1, 1))).alias("place"))


def _wrong(word, k):
    """A word with a letter lost, doubled or replaced, by k."""
    at = (k % F.length(word) + 1).cast("int")
    head, tail = F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word))
    return F.when(k % 4 == 0, F.concat(head, tail)).when(k % 4 == 1, F.concat(head, F.lit("q"), tail)).when(k % 4 == 2, F.concat(head, F.lit("zz"), tail)).otherwise(F.concat(word, F.substring(word, F.lit(1), F.lit(1))))


def fuzzy_names(spark, root):
    parts = table(spark, root, "part").select((F.col("p_partkey") * 7).alias("k"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w"))
    own = table(spark, root, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    words = parts.select(_wrong(F.lower("w"), F.col("k")).alias("word")).union(own)
    single = _names(spark, root).select(F.explode(F.split("name", " ")).alias("name"))
    return fuzzy.pairs(words, single).select("word", "name", "distance", F.bround("score", 9).alias("score"))


def routed_messages(spark, root):
    i = F.col("conv_id") * 100 + F.col("turn")
    names = _names(spark, root)
    parts = table(spark, root, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("own"), F.lower(F.split("p_name", " ")[1]).alias("w"))
    said = table(spark, root, "conversations").where("role = 'user' and turn is not null and conv_id is not null").select(i.alias("message_id"), (i % 150).alias("k"), "text").join(parts, "k")
    m = F.col("message_id")
    ask = F.when(m % 5 == 0, F.lit("What is its price?")).when(m % 5 == 1, F.lit("wanna know the warrenty")).when(m % 5 == 2, F.lit("Show the widgit, is it good")).when(m % 5 == 3, F.lit("+49 170 1234567")).otherwise(F.lit("list all products"))
    text = F.when(m % 5 == 3, ask).otherwise(F.concat(ask, F.lit(" "), _wrong(F.col("w"), m), F.lit("  "), F.translate(F.left("text", F.lit(20)), "?\n", " ")))
    messages = said.select("message_id", text.alias("text"), F.when(m % 3 == 0, F.col("own")).alias("product"))
    fixes = spark.createDataFrame(list(FIXES), "word string, replacement string, sure double, is_name boolean")
    rows = fuzzy.routed(messages, names, fixes, ratio=None)
    return rows.withColumn("entities", F.array_join("entities", "|"))


QUERIES = {"fuzzy_names": fuzzy_names, "routed_messages": routed_messages}

_WRONG = lambda w, k: f"CASE WHEN ({k}) % 4 = 0 THEN left({w}, ({k}) % length({w})) || substr({w}, ({k}) % length({w}) + 2) WHEN ({k}) % 4 = 1 THEN left({w}, ({k}) % length({w})) || 'q' || substr({w}, ({k}) % length({w}) + 2) WHEN ({k}) % 4 = 2 THEN left({w}, ({k}) % length({w})) || 'zz' || substr({w}, ({k}) % length({w}) + 2) ELSE {w} || left({w}, 1) END"
_NEAR = "w.word <> n.name AND length(w.word) BETWEEN 4 AND 20 AND length(n.name) BETWEEN 4 AND 20 AND levenshtein(w.word, n.name) <= CASE WHEN least(length(w.word), length(n.name)) < 8 THEN 1 ELSE 2 END"
_NAMES = "names AS MATERIALIZED (SELECT name, length(name) * 1000 + ascii(substr(name, 2, 1)) * 3 + ascii(right(name, 1)) AS place FROM (SELECT p_name AS name FROM part UNION SELECT p_type FROM part))"
_FIXES = ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {str(d).lower()})" for a, b, c, d in FIXES)
ORACLE_SQL = {
    "fuzzy_names": f"""WITH {_NAMES}, w AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT {_WRONG("lower(v)", "k")} AS word FROM (SELECT p_partkey * 7 AS k, unnest(string_split(p_name || ' ' || p_type, ' ')) AS v FROM part) UNION ALL SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM documents)),
n AS MATERIALIZED (SELECT DISTINCT lower(name) AS name FROM (SELECT unnest(string_split(name, ' ')) AS name FROM names))
SELECT word, name, levenshtein(word, name) AS distance, round_even(1 - levenshtein(word, name)::DOUBLE / greatest(length(word), length(name)), 9) AS score FROM w, n WHERE {_NEAR}""",
    "routed_messages": f"""WITH {_NAMES},
said AS (SELECT conv_id * 100 + turn AS message_id, c.text, p.p_name AS own, lower(string_split(p.p_name, ' ')[2]) AS w FROM conversations c JOIN part p ON p.p_partkey = (conv_id * 100 + turn) % 150 WHERE role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL),
m AS MATERIALIZED (SELECT message_id, trim(CASE WHEN message_id % 5 = 3 THEN '+49 170 1234567' ELSE CASE message_id % 5 WHEN 0 THEN 'What is its price?' WHEN 1 THEN 'wanna know the warrenty' WHEN 2 THEN 'Show the widgit, is it good' ELSE 'list all products' END || ' ' || {_WRONG("w", "message_id")} || '  ' || translate(left(text, 20), '?' || chr(10), ' ') END) AS text, CASE WHEN message_id % 3 = 0 THEN own ELSE '' END AS product, message_id % 5 = 3 AS still FROM said),
t AS MATERIALIZED (SELECT message_id, unnest(x) AS token, generate_subscripts(x, 1) AS n FROM (SELECT message_id, regexp_extract_all(text, '{fuzzy.TOKEN}') AS x FROM m WHERE NOT still)),
f(word, replacement, sure, is_name) AS (VALUES {_FIXES}), w AS (SELECT DISTINCT lower(token) AS word FROM t WHERE regexp_matches(token, '^[A-Za-z]') AND lower(token) NOT IN (SELECT word FROM f)),
s AS (SELECT string_split(name, ' ')[1] AS cased, place FROM names WHERE length(string_split(name, ' ')[1]) >= 4), n AS MATERIALIZED (SELECT lower(cased) AS name, min(place) AS place, min_by(cased, place) AS cased FROM s GROUP BY 1),
p AS (SELECT w.word, n.cased, row_number() OVER (PARTITION BY w.word ORDER BY levenshtein(w.word, n.name)::DOUBLE / greatest(length(w.word), length(n.name)), n.place, n.name) AS k FROM w, n WHERE {_NEAR} AND w.word NOT IN (SELECT lower(name) FROM names UNION SELECT name FROM n)),
g AS (SELECT * FROM f UNION ALL SELECT word, cased, {fuzzy.SURE_FUZZY}::DOUBLE, true FROM p WHERE k = 1),
b AS (SELECT message_id, string_agg(coalesce(replacement, token), '' ORDER BY n) AS put, min(sure) AS sure, list(DISTINCT replacement) FILTER (is_name) AS found FROM t LEFT JOIN g ON g.word = lower(token) GROUP BY message_id),
a AS MATERIALIZED (SELECT m.*, coalesce(put, text) AS put, sure, found, (SELECT min_by(name, place) FROM names WHERE contains(lower(coalesce(put, text)), lower(name))) AS named FROM m LEFT JOIN b USING (message_id)),
l AS (SELECT *, product <> '' AND NOT contains(lower(put), lower(product)) AND NOT regexp_matches(put, 'all products', 'i') AND (regexp_matches(put, '\\b(it|its|this|that|the product)\\b', 'i') OR (regexp_matches(put, '\\b(price|warranty|battery)\\b', 'i') AND (named IS NULL OR lower(named) = lower(product)))) AS leans, regexp_matches(put, '\\b(it|its|this|that|the product)\\b', 'i') AS points FROM a),
r AS (SELECT *, CASE WHEN still THEN text ELSE trim(regexp_replace(CASE WHEN leans AND points THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(put, '(?is)^(.*?)\\bits\\s+((?-s:.+?))(\\?|$)', '\\1the \\2 of ' || product || '\\3'), '(?i)\\bthe product\\b', product, 'g'), '(?i)\\bit\\b', product, 'g'), '(?i)\\bthis\\b', product, 'g'), '(?i)\\bthat\\b', product, 'g') WHEN leans THEN regexp_replace(put, '[ ?.!]+$', '') || ' of ' || product || '?' ELSE put END, '\\s+', ' ', 'g')) END AS rewritten FROM l)
SELECT message_id, rewritten, CASE WHEN rewritten = text THEN 1.0 ELSE least(coalesce(sure, 1.0), CASE WHEN leans THEN {fuzzy.SURE_REWRITE} ELSE 1.0 END) END::DOUBLE AS confidence, CASE WHEN still THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(coalesce(found, []) || [named, CASE WHEN leans THEN product END], lambda x: x IS NOT NULL))), '|') END AS entities FROM r""",
}
