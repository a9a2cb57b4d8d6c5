"""Registered queries of recovered structure. The tables' texts have few titles and clauses, so their lines are marked by
their number first, as pages and Markdown would be; the SQL does the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import structure as st
from ..sources.tables import table


def _marked(spark, root):
    """(document_id, text): the documents with every ninth line as a title, and so on."""

    def line(x, i):
        k, n = i % 9, (i + 1).cast("string")
        capitals = F.trim(F.regexp_replace(F.translate(F.left(x, F.lit(60)), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "[^A-Z ]", ""))
        return (
            F.when(k == 0, F.concat(F.lit("Section "), n, F.lit(" "), F.left(x, F.lit(40)))).when(k == 1, F.concat(F.lit("- "), F.left(x, F.lit(80)))).when(k == 2, F.concat(F.lit("* "), x))
            .when(k == 3, F.concat(n, F.lit(".1 "), F.lower(F.left(x, F.lit(100))))).when(k == 4, F.lit("")).when(k == 5, F.concat(F.lit("**"), n, F.lit(". "), F.left(x, F.lit(40)), F.lit("**")))
            .when(k == 6, F.concat(F.lit("**"), F.left(x, F.lit(30)), F.lit("**"))).when(k == 7, capitals).otherwise(F.concat(F.lit("Q"), n, F.lit(". "), x))
        )

    docs = table(spark, root, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("lines"))
    twice = F.transform("lines", lambda x, i: F.concat(line(x, i), F.lit("\n"), x))  # each marked line, then the line itself
    return docs.select("document_id", F.array_join(twice, "\n").alias("text"))


def _trees(spark, root):
    nodes = st.as_nodes(_marked(spark, root))
    return [(layout, nodes, st.recovered(nodes, layout)) for layout in (True, False)]


def recovered_structure(spark, root):
    """The nodes of every document's recovered tree, as a laid-out page and as Markdown."""
    trees = [st.numbered(after).withColumn("layout", F.lit(layout)) for layout, _, after in _trees(spark, root)]
    rows = reduce(lambda a, b: a.union(b), trees)
    return rows.select("document_id", "layout", F.array_join("path", ".").alias("path"), "depth", "node_type", "level", F.array_join("headings", " > ").alias("headings"), F.length("text").alias("n"), F.sha2("text", 256).alias("text_sha256"), "clause")


def recovery_report(spark, root):
    rows = [st.recovery_report(before, after).withColumn("layout", F.lit(layout)) for layout, before, after in _trees(spark, root)]
    return reduce(lambda a, b: a.union(b), rows)


def section_tree(spark, root):
    """The tree by heading levels: lines of the documents, of which every third is a heading of level 1 to 6 by its length."""
    rows = table(spark, root, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    heading = F.col("ord") % 3 == 0
    level = F.when(heading, F.length("text") % 6 + 1).cast("int")
    blocks = rows.select("document_id", "ord", F.when(heading, "heading").otherwise("paragraph").alias("node_type"), level.alias("level"), "text")
    tree = st.numbered(st.by_levels(blocks), 5)
    return tree.select("document_id", F.array_join("path", ".").alias("path"), "depth", "node_type", "level", F.sha2(F.array_join("headings", " > "), 256).alias("headings_sha256"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"recovered_structure": recovered_structure, "recovery_report": recovery_report, "section_tree": section_tree}

_BL = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
_S = lambda x: f"trim({x}, {_BL})"
_M = lambda x, p: "regexp_matches({}, '{}')".format(x, p.replace("'", "''"))
_X = lambda x, p, k: "regexp_extract({}, '{}', {})".format(x, p.replace("'", "''"), k)
_L = lambda x: f"regexp_split_to_array({x}, '{st.LINE_END}')"


def _giant(text: str) -> str:
    own, y = _S(text), _S("y")
    return f"({_M(own, st.BOLD)} OR len(list_filter({_L(own)}, lambda y: {_M(y, st.CLAUSE)} OR {_M(y, st.BOLD)})) >= 2 OR length({own}) >= {st.GIANT_CHARS})"


def _once(src: str, out: str, layout: bool) -> str:
    """The CTEs that cut the giant paragraphs of src."""
    title = f"(length(own) <= {st.LONGEST_TITLE} AND ({_M('own', st.PART)} OR ({_M('own', st.CAPITALS)} AND length(regexp_replace(own, '[^\\p{{L}}]', '', 'g')) >= {st.LETTERS_OF_A_TITLE}) OR {_M('own', st.NUMBERED)}))"
    bare = r"regexp_replace(line, '[ \t\n\r\f\x0b]+$', '')"
    if layout:
        kind = f"CASE WHEN own = '' THEN 'blank' WHEN {_M('own', st.BULLET)} THEN 'list' WHEN {title} THEN 'section' WHEN {_M('own', st.CLAUSE)} THEN 'clause' ELSE 'paragraph' END"
        text = f"CASE kind WHEN 'list' THEN {_S(_X('own', st.BULLET, 1))} WHEN 'section' THEN own WHEN 'clause' THEN own ELSE {bare} END"
        same = "AND NOT (n = 1 AND only_kind IN ('paragraph', 'clause'))"
    else:
        inner = _S(_X("own", st.BOLD, 1))
        kind = f"CASE WHEN own = '' THEN 'blank' WHEN {_M('own', st.BOLD)} THEN CASE WHEN {_M(inner, st.BOLD_NUMBER)} THEN 'section' ELSE 'heading' END WHEN {_M('own', st.CLAUSE)} THEN 'clause' ELSE 'paragraph' END"
        text = f"CASE kind WHEN 'section' THEN {_X(inner, st.BOLD_NUMBER, 1)} || '. ' || {_S(_X(inner, st.BOLD_NUMBER, 2))} WHEN 'heading' THEN {inner} WHEN 'clause' THEN own ELSE {bare} END"
        same = ""
    return f"""{out}g AS MATERIALIZED (SELECT *, node_type = 'paragraph' AND {_giant("text")} AS whole FROM {src}),
{out}l AS (SELECT document_id, key, unnest({_L("text")}) AS line, generate_subscripts({_L("text")}, 1) AS i FROM {out}g WHERE whole),
{out}k AS (SELECT *, {kind} AS kind FROM (SELECT *, {_S("line")} AS own FROM {out}l)),
{out}s AS (SELECT *, {text} AS t, kind <> 'blank' AND (kind IN ('section', 'heading', 'clause') OR kind <> coalesce(lag(kind) OVER w, 'blank')) AS st FROM {out}k WINDOW w AS (PARTITION BY document_id, key ORDER BY i)),
{out}o AS (SELECT *, sum(st::INT) OVER (PARTITION BY document_id, key ORDER BY i) - 1 AS b FROM {out}s),
{out}b AS MATERIALIZED (SELECT document_id, key, b, any_value(kind) AS kind, CASE WHEN any_value(kind) = 'paragraph' THEN {_S("string_agg(t, chr(10) ORDER BY i)")} ELSE string_agg(t, chr(10) ORDER BY i) END AS t FROM {out}o WHERE kind <> 'blank' GROUP BY document_id, key, b),
{out}f AS (SELECT document_id, key, count(*) AS n, any_value(kind) AS only_kind, min(b) FILTER (kind = 'section') AS f FROM {out}b GROUP BY document_id, key),
{out}h AS MATERIALIZED (SELECT g.*, f.f, coalesce(whole {same}, false) AND n > 0 AS cut FROM {out}g g LEFT JOIN {out}f f USING (document_id, key)),
{out} AS MATERIALIZED (
  SELECT document_id, key, depth, node_type, level, text, clause, found FROM {out}h WHERE NOT cut UNION ALL
  SELECT document_id, list_append(h.key, b.b::INT), depth + (b.kind <> 'section' AND coalesce(b.b > h.f, false))::INT, CASE b.kind WHEN 'clause' THEN 'paragraph' ELSE b.kind END, CASE b.kind WHEN 'section' THEN 2 WHEN 'heading' THEN 3 END, b.t, b.kind = 'clause', b.kind IN ('section', 'heading', 'clause')
  FROM {out}h h JOIN {out}b b USING (document_id, key) WHERE h.cut)"""


def _numbered(src: str, out: str, deepest: int) -> str:
    d = range(deepest + 1)
    starts = ", ".join(f"count(*) FILTER (depth < {k}) OVER (PARTITION BY document_id ORDER BY key) AS g{k}" for k in d)
    numbers = ", ".join(f"count(*) FILTER (depth = {k}) OVER (PARTITION BY document_id, g{k} ORDER BY key) AS n{k}, last_value(CASE WHEN depth = {k} AND node_type = 'section' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id, g{k} ORDER BY key) AS h{k}" for k in d)
    return f"""{out}a AS (SELECT *, {starts} FROM (SELECT * REPLACE (least(depth, {deepest}) AS depth) FROM {src})),
{out}b AS (SELECT *, {numbers} FROM {out}a),
{out} AS (SELECT document_id, array_to_string([{", ".join(f"n{k}" for k in d)}][1:depth + 1], '.') AS path, depth, node_type, level, coalesce(array_to_string([{", ".join(f"h{k}" for k in d)}][1:depth], ' > '), '') AS headings, text, clause, found FROM {out}b)"""


_TEXTS = """WITH m AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS lines FROM documents),
e AS (SELECT document_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS n FROM m),
q AS (SELECT document_id, n, x, CASE (n - 1) % 9 WHEN 0 THEN 'Section ' || n || ' ' || left(x, 40) WHEN 1 THEN '- ' || left(x, 80) WHEN 2 THEN '* ' || x WHEN 3 THEN n || '.1 ' || lower(left(x, 100)) WHEN 4 THEN '' WHEN 5 THEN '**' || n || '. ' || left(x, 40) || '**' WHEN 6 THEN '**' || left(x, 30) || '**'
  WHEN 7 THEN trim(regexp_replace(translate(left(x, 60), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z ]', '', 'g')) ELSE 'Q' || n || '. ' || x END AS y FROM e),
v AS MATERIALIZED (SELECT document_id, [0] AS key, 0 AS depth, 'paragraph' AS node_type, NULL::INT AS level, string_agg(y || chr(10) || x, chr(10) ORDER BY n) AS text, false AS clause, false AS found FROM q GROUP BY document_id),
""" + ",\n".join([_once("v", "x1", True), _once("x1", "x2", False), _once("v", "y1", False)])


def _counts(src: str) -> str:
    asked = f"CASE WHEN node_type = 'paragraph' THEN len(list_filter({_L('text')}, lambda y: {_M(_S('y'), st.QUESTION)})) + {_M(_L(_S('text')) + '[1]', st.QUESTION)}::INT WHEN node_type = 'heading' AND ends_with({_S('text')}, '?') THEN 1 ELSE 0 END"
    return f"""SELECT document_id, count(*) FILTER (node_type = 'section' AND found) AS sections, count(*) FILTER (node_type IN ('section', 'heading') AND found) AS headings, count(*) FILTER (clause) AS clauses,
  sum(CASE WHEN node_type = 'list' THEN len({_L("text")}) ELSE 0 END)::BIGINT AS list_items, count(*) FILTER (node_type = 'table') AS tables, count(*) FILTER (node_type = 'list') AS lists, count(*) FILTER (node_type = 'paragraph' AND {_giant("text")}) AS giants_after, sum({asked})::BIGINT AS questions FROM {src} GROUP BY 1"""


_LEVELS = ", ".join(f"coalesce(max(CASE WHEN level = {k} THEN ord END) OVER w, -1) AS l{k}" for k in range(1, 7))
_OPEN = " + ".join(f"(l{k} >= 0 AND coalesce(level > {k}, true){f' AND l{k} > greatest({", ".join(f"l{j}" for j in range(1, k))}, -2)' if k > 1 else ''})::INT" for k in range(1, 7))
ORACLE_SQL = {
    "recovered_structure": f"{_TEXTS},\n{_numbered('x2', 'p', 4)},\n{_numbered('y1', 'r', 4)}\nSELECT document_id, layout, path, depth, node_type, level, headings, length(text) AS n, sha256(text) AS text_sha256, clause FROM (SELECT *, true AS layout FROM p UNION ALL SELECT *, false FROM r)",
    "recovery_report": f"{_TEXTS} SELECT a.*, b.giants_before FROM (SELECT *, true AS layout FROM ({_counts('x2')}) UNION ALL SELECT *, false FROM ({_counts('y1')})) a JOIN (SELECT document_id, count(*) FILTER ({_giant('text')}) AS giants_before FROM v GROUP BY 1) b USING (document_id)",
    "section_tree": f"""WITH e AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents),
b AS (SELECT document_id, ord, CASE WHEN ord % 3 = 0 THEN 'section' ELSE 'paragraph' END AS node_type, CASE WHEN ord % 3 = 0 THEN (length(text) % 6 + 1)::INT END AS level, text FROM e),
s AS (SELECT *, {_LEVELS} FROM b WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT document_id, [ord::INT] AS key, {_OPEN} AS depth, node_type, level, text, false AS clause, false AS found FROM s),
{_numbered("t", "p", 5)}
SELECT document_id, path, depth, node_type, level, sha256(headings) AS headings_sha256, sha256(text) AS text_sha256 FROM p""",
}
