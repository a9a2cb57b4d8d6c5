"""Structure recovered from flat text: long paragraphs become sections, headings, clauses and lists, and a tree of nodes.

A tree is a table of nodes (document_id, key, depth, node_type, level, text). `key` is an array of integers whose order is
the document's order; `depth` is the number of sections around a node; a section's text is its heading, a list's its items
by line. Cutting a node gives it longer keys, so no other node moves; numbered() then turns keys and depths into paths.

The line automaton runs inside the row, in column functions: every line has a kind, a block starts where the kind changes
or stands alone, and its text is a slice of the lines. Nothing is shuffled, and the work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: What lines look like. Names of parts of a book, runs of capitals, numbered titles and clauses, bullets,
#: bold lines and numbered ones among them, and questions.
PART = r"(?i)^(PART|SECTION|CHAPTER|ANNEXURE|APPENDIX|SCHEDULE)\s+[IVXLC\d]+"
CAPITALS = r"""^[A-Z0-9][A-Z0-9\s&,\-./():'"]{3,80}$"""
NUMBERED = r"^\d+(\.\d+)*\s+[A-Z][A-Za-z0-9].{2,}$"
CLAUSE = r"^\d+\.\d+(\.\d+)?\s+.+$"
BULLET = r"^[\x{2022}\-*]\s+(.+)$"
BOLD = r"^\*\*(.+?)\*\*\s*$"
BOLD_NUMBER = r"^(\d+)\.\s+(.+)$"
QUESTION = r"(?i)^Q\d+\.\s+.+$"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLANKS = " \t\n\r\f\x0b"
#: Paragraphs from this length on are cut, whatever they hold.
GIANT_CHARS, LONGEST_TITLE, LETTERS_OF_A_TITLE = 400, 120, 4
#: Kinds of line that are a block of their own.
ALONE = ("section", "heading", "clause")


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _bold(line: Column) -> Column:
    return stripped(F.regexp_extract(line, BOLD, 1))


def giant(text: Column) -> Column:
    """Whether a paragraph is to be cut: it is one bold line, has two clauses or bold lines, or is long."""
    own = stripped(tx.filled(text))
    marked = F.size(F.filter(F.transform(F.split(own, LINE_END), stripped), lambda x: x.rlike(CLAUSE) | (F.startswith(x, F.lit("**")) & x.rlike(BOLD))))
    return (F.length(own) >= GIANT_CHARS) | own.rlike(BOLD) | (marked >= 2)


def title(line: Column) -> Column:
    """Whether a stripped line of a laid-out page is a heading."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return (F.length(line) <= LONGEST_TITLE) & (line.rlike(PART) | (line.rlike(CAPITALS) & (letters >= LETTERS_OF_A_TITLE)) | line.rlike(NUMBERED))


def _kind(own: Column, layout: bool) -> Column:
    """The kind of a stripped line. On laid-out pages, titles open sections and bullets make lists; elsewhere, bold lines
    with a number open sections and other bold lines are headings. Clauses stand alone in both."""
    if layout:
        return F.when(own == "", "blank").when(own.rlike(BULLET), "list").when(title(own), "section").when(own.rlike(CLAUSE), "clause").otherwise("paragraph")
    bold = F.when(_bold(own).rlike(BOLD_NUMBER), "section").otherwise("heading")
    return F.when(own == "", "blank").when(F.startswith(own, F.lit("**")) & own.rlike(BOLD), bold).when(own.rlike(CLAUSE), "clause").otherwise("paragraph")


def _content(raw: Column, own: Column, kind: Column, layout: bool) -> Column:
    as_is = F.regexp_replace(raw, r"[ \t\n\r\f\x0B]+$", "")
    if layout:
        return F.when(kind == "list", stripped(F.regexp_extract(own, BULLET, 1))).when(kind.isin("section", "clause"), own).otherwise(as_is)
    inner = _bold(own)
    numbered = F.concat(F.regexp_extract(inner, BOLD_NUMBER, 1), F.lit(". "), stripped(F.regexp_extract(inner, BOLD_NUMBER, 2)))
    return F.when(kind == "section", numbered).when(kind == "heading", inner).when(kind == "clause", own).otherwise(as_is)


def _lines(text: Column, layout: bool) -> Column:
    """struct(kind, text) of each line. Every step names what the one before has found, so a pattern is tried once a line."""
    bare = F.transform(F.split(text, LINE_END), lambda x: F.struct(x.alias("raw"), stripped(x).alias("own")))
    sorted_ = F.transform(bare, lambda x: F.struct(x["raw"].alias("raw"), x["own"].alias("own"), _kind(x["own"], layout).alias("kind")))
    return F.transform(sorted_, lambda x: F.struct(x["kind"].alias("kind"), _content(x["raw"], x["own"], x["kind"], layout).alias("text")))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are evaluated once a row. The optimizer would copy a column that is named once into the lambda
    that names it, and so evaluate it for each element; it copies nothing across a generator."""
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held")).select("*", "_held.*").drop("_held")


def with_blocks(rows: DataFrame, text_col: str, lines: Callable[[Column], Column]) -> DataFrame:
    """Adds `blocks`, the array of struct(kind, text) that the lines of a text make, in order; null for a null text. `lines`
    gives the array of struct(kind, text) of a text's lines."""
    at = held(rows, _lines=lines(F.col(text_col)))
    kinds = F.transform("_lines", lambda x: x["kind"])
    before = F.concat(F.array(F.lit("blank")), F.slice(kinds, 1, F.size(kinds) - 1))
    first = F.zip_with(kinds, before, lambda k, b: (k != "blank") & (k.isin(*ALONE) | (k != b)))
    at = held(at, _starts=F.filter(F.transform(first, lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull()))
    ends = F.concat(F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), F.array(F.size("_lines") + 1))

    def block(a: Column, b: Column) -> Column:
        own = F.filter(F.slice(F.col("_lines"), a, b - a), lambda x: x["kind"] != "blank")
        kind, joined = F.col("_lines")[a - 1]["kind"], F.array_join(F.transform(own, lambda x: x["text"]), "\n")
        return F.struct(kind.alias("kind"), F.when(kind == "paragraph", stripped(joined)).otherwise(joined).alias("text"))

    blocks = F.when(F.size("_starts") > 0, F.zip_with("_starts", ends, block)).otherwise(F.when(F.col("_starts").isNotNull(), F.array().cast("array<struct<kind:string,text:string>>")))
    return held(at, blocks=blocks).drop("_lines", "_starts")


def recovered_once(nodes: DataFrame, layout: bool) -> DataFrame:
    """Cuts each giant paragraph of a tree. A section takes in what follows it in the paragraph. On laid-out pages a
    paragraph that stays one paragraph is left as it is."""
    whole = F.coalesce((F.col("node_type") == "paragraph") & giant(F.col("text")), F.lit(False))
    cut = with_blocks(nodes.withColumn("_whole", F.when(whole, F.col("text"))), "_whole", lambda t: _lines(t, layout))
    split = F.col("_whole").isNotNull()
    if layout:
        split = split & ~((F.size("blocks") == 1) & F.col("blocks")[0]["kind"].isin("paragraph", "clause"))
    first = F.array_position(F.transform("blocks", lambda b: b["kind"]), F.lit("section"))

    def node(b: Column, i: Column) -> Column:
        kind = b["kind"]
        inside = (F.col("_first") > 0) & (i + 1 > F.col("_first")) & (kind != "section")
        return F.struct(
            F.concat("key", F.array(i)).alias("key"), (F.col("depth") + inside.cast("int")).alias("depth"), F.when(kind == "clause", "paragraph").otherwise(kind).alias("node_type"),
            F.when(kind == "section", 2).when(kind == "heading", 3).alias("level"), b["text"].alias("text"), (kind == "clause").alias("clause"), kind.isin(*ALONE).alias("found"),
        )

    own = F.array(F.struct("key", "depth", "node_type", "level", "text", "clause", "found"))
    parts = held(cut, _first=first).withColumn("_parts", F.when(split & (F.size("blocks") > 0), F.transform("blocks", node)).otherwise(own))
    return parts.select("document_id", F.explode_outer("_parts").alias("_n")).select("document_id", "_n.*")


def as_nodes(rows: DataFrame, id_col: str = "document_id", text_col: str = "text", order_col: str | None = None, type_col: str | None = None) -> DataFrame:
    """Rows as the nodes of flat trees: of each document, its blocks by order_col, or the whole text as one paragraph. Null
    texts are empty."""
    key = F.array(F.col(order_col).cast("int")) if order_col else F.array(F.lit(0))
    kind = F.col(type_col) if type_col else F.lit("paragraph")
    level = F.lit(None).cast("int")
    return rows.select(F.col(id_col).alias("document_id"), key.alias("key"), F.lit(0).alias("depth"), kind.alias("node_type"), level.alias("level"), tx.filled(F.col(text_col)).alias("text"), F.lit(False).alias("clause"), F.lit(False).alias("found"))


def recovered(nodes: DataFrame, layout: bool = False) -> DataFrame:
    """The tree with its giant paragraphs cut. Laid-out pages are cut by their layout first, then what is still giant, in
    and outside the new sections, by its marks; more rounds would find nothing new."""
    return recovered_once(recovered_once(nodes, True), False) if layout else recovered_once(nodes, False)


def by_levels(blocks: DataFrame) -> DataFrame:
    """The tree that headings of several levels make: blocks (document_id, ord, node_type, level, text) with headings as
    sections. A heading closes the open ones of its level and deeper, as on a stack; here each level's last heading is
    open while no heading of a smaller level follows it, so the stack is six running maxima."""
    order = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.coalesce(F.max(F.when(F.col("level") == k, F.col("ord"))).over(order), F.lit(-1)) for k in range(1, 7)]
    rows = blocks.select("*", *[x.alias(f"_l{k}") for k, x in enumerate(last, 1)])
    open_at = lambda k: (F.col(f"_l{k}") >= 0) & (F.lit(True) if k == 1 else (F.col(f"_l{k}") > F.greatest(*[F.col(f"_l{j}") for j in range(1, k)], F.lit(-2))))
    depth = sum(((open_at(k) & F.coalesce(F.col("level") > k, F.lit(True))).cast("int") for k in range(1, 7)), F.lit(0))
    kind = F.when(F.col("node_type") == "heading", "section").otherwise(F.col("node_type"))
    return rows.select("document_id", F.array(F.col("ord").cast("int")).alias("key"), depth.alias("depth"), kind.alias("node_type"), F.col("level").cast("int").alias("level"), "text", F.lit(False).alias("clause"), F.lit(False).alias("found"))


def numbered(nodes: DataFrame, deepest: int = 4) -> DataFrame:
    """(document_id, path, depth, node_type, level, headings, text, clause, found): `path` holds each ancestor's number among
    its siblings and the node's own, from 1; `headings` the texts of the sections around it. A node deeper than `deepest`
    sections hangs on the deepest."""
    nodes = nodes.withColumn("depth", F.least("depth", F.lit(deepest)))
    for d in range(deepest + 1):  # nodes of a smaller depth start the numbers of this one anew
        nodes = nodes.withColumn(f"_g{d}", F.count_if(F.col("depth") < d).over(Window.partitionBy("document_id").orderBy("key")))
    for d in range(deepest + 1):
        order = Window.partitionBy("document_id", f"_g{d}").orderBy("key")
        nodes = nodes.withColumn(f"_n{d}", F.count_if(F.col("depth") == d).over(order))
        nodes = nodes.withColumn(f"_h{d}", F.last(F.when((F.col("depth") == d) & (F.col("node_type") == "section"), F.col("text")), ignorenulls=True).over(order))
    path = F.slice(F.array(*[F.col(f"_n{d}") for d in range(deepest + 1)]), 1, F.col("depth") + 1)
    headings = F.slice(F.array(*[F.col(f"_h{d}") for d in range(deepest + 1)]), 1, F.col("depth"))
    return nodes.select("document_id", path.alias("path"), "depth", "node_type", "level", headings.alias("headings"), "text", "clause", "found")


def plain_text(nodes: DataFrame, between: str = "\n\n") -> DataFrame:
    """(document_id, text): the tree flattened again, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("key", "text")))
    return nodes.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), between).alias("text"))


def counts(nodes: DataFrame) -> DataFrame:
    """(document_id, sections, headings, clauses, list_items, tables, lists, giants, questions). `headings` counts the
    recovered sections too. A question is a line that begins with Q and a number, or a heading that ends in a question
    mark; a paragraph's first line counts twice, as the paragraph and as its line."""
    kind, lines = F.col("node_type"), F.split("text", LINE_END)
    asked = F.size(F.filter(lines, lambda x: stripped(x).rlike(QUESTION))) + F.split(stripped(F.col("text")), LINE_END)[0].rlike(QUESTION).cast("int")
    asked = F.when(kind == "paragraph", asked).when((kind == "heading") & F.endswith(stripped(F.col("text")), F.lit("?")), 1).otherwise(0)
    return nodes.groupBy("document_id").agg(
        F.count_if((kind == "section") & F.col("found")).alias("sections"), F.count_if(kind.isin("section", "heading") & F.col("found")).alias("headings"), F.count_if("clause").alias("clauses"),
        F.sum(F.when(kind == "list", F.size(lines)).otherwise(0)).alias("list_items"), F.count_if(kind == "table").alias("tables"), F.count_if(kind == "list").alias("lists"),
        F.count_if((kind == "paragraph") & giant(F.col("text"))).alias("giants"), F.sum(asked).alias("questions"),
    )


def recovery_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """counts() of the recovered tree, with giants_before and giants_after."""
    was = counts(before).select("document_id", F.col("giants").alias("giants_before"))
    return counts(after).withColumnRenamed("giants", "giants_after").join(was, "document_id")
