"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget goes down the tree domain, language, source. Each node shares its budget among its children by weight;
a child that can't use its share leaves the rest to its siblings (by weight again), and only what a whole node can't
use goes to the node's own siblings. Each leaf then takes the prefix of its documents, in a seeded order for each
epoch, that its budget allows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checked_broadcast, free_name, written

LEVELS = ("domain", "lang", "source")
WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Params:
    #: Integer weights of the names of each level; names that are not listed weigh 1, those of weight 0 or less get nothing.
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    #: The budget is this share of all tokens, as numerator and denominator; `budget` overrides it.
    share: tuple[int, int] = (3, 5)
    budget: int | None = None
    #: How many times a document may be taken.
    epochs: int = 2
    seed: int = 17


#: What the registered query and the pipeline mix by. The tables know no domains: a source's is its number modulo 4.
TABLE_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 4, "de": 2}}


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("d"), (F.coalesce(F.expr("try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') as int)"), F.lit(0)) % 4).cast("string"))


def _weight(p: Params, level: str) -> Column:
    known = p.weights.get(level, {})
    if not known:
        return F.lit(1)
    return F.greatest(F.lit(0), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col(level)), F.lit(1)))


def _shared(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Adds `budget`, the share of the parent's budget `given`, to child nodes with capacity `cap` and weight `w`.

    By rising cap / w, a child is full if cap times the weight still open is at most its weight times the budget still
    open; the others share what remains by running floors, in order of their names, so that every token is given."""
    live = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0).cast(WIDE)).withColumn("w", F.col("w").cast(WIDE))
    rising = Window.partitionBy(*parent).orderBy((F.col("cap").cast("double") / F.greatest("w", F.lit(1))).asc(), F.col(level))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    live = live.withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(WIDE)).withColumn("open", F.sum("w").over(rest).cast(WIDE))
    live = live.withColumn("full", (F.col("w") <= 0) | (F.col("cap") * F.col("open") <= (F.col("given") - F.col("used")) * F.col("w")))
    all_of = Window.partitionBy(*parent)
    open_w = F.when(~F.col("full"), F.col("w")).otherwise(0)
    live = live.withColumn("remains", (F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_of)).cast(WIDE)).withColumn("open", F.sum(open_w).over(all_of).cast(WIDE))
    named = Window.partitionBy(*parent).orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    live = live.withColumn("upto", F.sum(open_w).over(named).cast(WIDE))
    floor = lambda w: F.expr(f"(remains * ({w})) div nullif(open, 0)")
    return live.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(floor("upto") - floor("upto - w")).cast("long")).select(*parent, level, "budget")


def budgets(leaves: DataFrame, p: Params, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(levels..., tokens, budget) of each leaf (levels..., tokens). The leaves are as many as the sources."""
    weight = F.lit(1)
    for level in levels:
        weight = weight * F.when(_weight(p, level) > 0, 1).otherwise(0)
    leaves = leaves.withColumn("cap", (F.col("tokens") * p.epochs * weight).cast(WIDE))
    total = F.lit(p.budget) if p.budget is not None else F.expr(f"(sum(tokens) over () * {p.share[0]}) div {p.share[1]}")
    leaves = leaves.withColumn("total", F.least(total.cast(WIDE), F.sum("cap").over(Window.partitionBy())))
    given = None
    for depth, level in enumerate(levels):
        parent, keys = list(levels[:depth]), list(levels[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max("total").alias("given")).withColumn("w", _weight(p, level))
        if given is not None:
            nodes = nodes.drop("given").join(given.withColumnRenamed("budget", "given"), parent)
        given = _shared(nodes.withColumn("given", F.col("given").cast(WIDE)), parent, level)
    return leaves.select(*levels, "tokens").join(given, list(levels))


def mixed(documents: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(id, levels..., n_tokens, budget, copies) for every row: how often the mixture takes it, 0 to epochs.

    A token is a run of characters that are not white space. A leaf with budget b and t tokens takes all its documents
    b div t times and, of the next epoch, those whose running sum stays within the rest, in the order of the MD5 of
    seed, epoch and id, then id. Sums over 4,096 ranges of that hash find the range where the budget ends; only that
    range's rows are ordered, so a leaf with a third of all rows is no single task's work.

    Null levels count as the name ''; null and empty texts have no tokens and are taken with every epoch that is begun
    up to their place; rows that repeat an id are separate documents with the same place. An empty table gives none.
    """
    named = documents.select(F.col(id_col).alias("id"), *[F.coalesce(level, F.lit("")).alias(level) for level in levels], F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens"))
    narrow = written(named, "tokens")
    leaves = written(budgets(narrow.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), p, levels), "leaves")
    leaves = leaves.withColumn("whole", F.coalesce(F.expr("budget div nullif(tokens, 0)"), F.lit(0))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    place = F.md5(F.concat_ws(":", F.lit(p.seed).cast("string"), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    placed = narrow.join(checked_broadcast(leaves, 200), list(levels)).withColumn("h", place).withColumn("range", F.substring("h", 1, 3))
    upto = Window.partitionBy(*levels).orderBy("range")
    ranges = written(
        placed.groupBy(*levels, "range").agg(F.sum("n_tokens").alias("n"), F.max("rest").alias("r"))
        .withColumn("end", F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("start", F.col("end") - F.col("n"))
        .select(*levels, "range", "start", (F.col("end") <= F.col("r")).alias("inside"), ((F.col("start") <= F.col("r")) & (F.col("end") > F.col("r"))).alias("cut")),
        "ranges",
    )
    seen = placed.join(checked_broadcast(ranges, 200), [*levels, "range"])
    out = [id_col if c == "id" else c for c in ("id", *levels, "n_tokens", "budget")]
    clear = seen.where("not cut").withColumn("more", F.col("inside").cast("int"))
    ordered = Window.partitionBy(*levels).orderBy("h", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = seen.where("cut").withColumn("more", ((F.sum("n_tokens").over(ordered) + F.col("start")) <= F.col("rest")).cast("int"))
    found = clear.unionByName(cut)
    live = F.lit(True)
    for level in levels:
        live = live & (_weight(p, level) > 0)
    copies = F.when(live, F.least(F.lit(p.epochs), F.col("whole") + F.col("more"))).otherwise(0)
    return found.select(F.col("id").alias(id_col), *levels, "n_tokens", "budget", copies.cast("int").alias("copies")).select(*out, "copies")


def mixture(documents: DataFrame, p: Params, levels: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """documents as the mixture takes them, with their own columns only; a row comes once for each epoch that takes it.
    levels: the column of each level. Rows that repeat an id come as often as the one that is taken most."""
    named = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(name) for name, c in levels.items()])
    taken = mixed(named, p, "id", "text", tuple(levels)).where("copies > 0")
    own, copies, epoch = (free_name(documents, x) for x in ("taken_id", "copies", "epoch"))
    taken = written(taken.groupBy(F.col("id").alias(own)).agg(F.max("copies").alias(copies)), "taken")
    found = documents.join(checked_broadcast(taken, 40), F.col(id_col).eqNullSafe(F.col(own)))
    if p.epochs > 1:
        found = found.withColumn(epoch, F.explode(F.sequence(F.lit(1), copies)))
    return found.select(documents.columns)


def op10_mixing(documents: DataFrame) -> DataFrame:
    """Every document with its leaf, tokens and copies at the table's weights, as mixed() defines them."""
    return mixed(documents.withColumn("domain", domain_of(F.col("source"))), Params(TABLE_WEIGHTS))


def _oracle() -> str:
    """Level by level, the same integer arithmetic."""
    case = lambda level: "CASE " + level + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TABLE_WEIGHTS.get(level, {}).items()) + " ELSE 1 END" if TABLE_WEIGHTS.get(level) else "1"
    sql = r"""
WITH t AS (SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS INT), 0) % 4) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, 2 * sum(n_tokens)::HUGEINT AS cap FROM t GROUP BY ALL),
g0 AS (SELECT least((sum(tokens) * 3) // 5, sum(cap))::HUGEINT AS budget FROM leaf)"""
    for depth, level in enumerate(LEVELS):
        keys, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        part = f"PARTITION BY {parent}" if parent else ""
        join = f"JOIN g{depth} USING ({parent})" if parent else "CROSS JOIN g0"
        sql += f""",
n{depth} AS (SELECT n.*, g{depth}.budget AS given, ({case(level)})::HUGEINT AS w FROM (SELECT {keys}, sum(cap)::HUGEINT AS cap FROM leaf GROUP BY ALL) n {join}),
f{depth} AS (SELECT *, cap * open <= (given - used) * w AS full_ FROM (SELECT *, coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS used,
  sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS open FROM n{depth} WINDOW r AS ({part} ORDER BY cap::DOUBLE / w, {level}))),
s{depth} AS (SELECT *, given - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({part})::HUGEINT AS remains, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({part})::HUGEINT AS ow,
  sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({part} ORDER BY {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::HUGEINT AS upto FROM f{depth}),
g{depth + 1} AS (SELECT {keys}, (CASE WHEN full_ THEN cap ELSE (remains * upto) // nullif(ow, 0) - (remains * (upto - w)) // nullif(ow, 0) END)::HUGEINT AS budget FROM s{depth})"""
    return sql + """,
q AS (SELECT *, coalesce(budget // nullif(tokens, 0), 0) AS whole FROM leaf JOIN g3 USING (domain, lang, source)),
p AS (SELECT t.*, q.budget, q.whole, q.budget - q.whole * q.tokens AS rest, md5('17:' || (q.whole + 1) || ':' || doc_id) AS h FROM t JOIN q USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, domain, lang, source, n_tokens, budget::BIGINT AS budget, least(2, whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INT AS copies FROM c"""


ORACLE = _oracle()
