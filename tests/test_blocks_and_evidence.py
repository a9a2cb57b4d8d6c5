"""Blocks and evidence on literals."""

import json

from pyspark.sql import functions as F

from quarryspark.functions import text as tx
from quarryspark.operators import blocks, evidence

MARKDOWN = "intro\nmore\n\n# One\n- a\n- b\n  - c\n| h | i |\n|---|---|\n| 1 | 2 |\n### Sub\ntext ![x](y)\n## Two\nend"


def test_markdown_blocks(spark):
    got = blocks.markdown_blocks(spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r["node_type"], r["level"], r["section"], r["text"]) for r in got] == [
        ("paragraph", None, None, "intro\nmore"), ("heading", 1, "One", "One"), ("list", None, "One", "a\nb"), ("list", None, "One", "c"),
        ("table", None, "One", "| h | i |\n|---|---|\n| 1 | 2 |"), ("heading", 3, "One", "Sub"), ("paragraph", None, "One", "text ![x](y)"), ("heading", 2, "Two", "Two"), ("paragraph", None, "Two", "end"),
    ]


def test_counts_and_text(spark):
    own = blocks.markdown_blocks(spark.createDataFrame([(1, "# A\n\n# A\n\n" + "x" * 400)], "doc_id long, text string"))
    row = blocks.structure_counts(own).first()
    assert (row["headings"], row["repeated_headings"], row["giants"]) == (2, 1, 1)
    assert blocks.plain_text(own).first()["text"] == "A\n\nA\n\n" + "x" * 400


def test_facts(spark):
    rows = [("Two Years", "has two  years".replace("  ", " "), True), ("one|three", "three things", True), ("one/three", "two", False), ("warranty of it", "the warranty", True), ("a b c", "x", False)]
    got = spark.createDataFrame(rows, "f string, t string, e boolean").select("e", evidence.fact_matches(F.col("f"), F.col("t")).alias("m")).collect()
    assert all(r["e"] == r["m"] for r in got)


def test_needles_keep_the_best(spark):
    wanted = spark.createDataFrame([(1, ["first needle here", "second needle here"])], "query_id long, needles array<string>")
    rows = [(1, "a", "First  needle here"), (1, "b", "first needle here, second needle here"), (1, "c", "none")]
    got = evidence.best_by_needles(spark.createDataFrame(rows, "query_id long, chunk_id string, text string"), wanted).collect()
    assert [(r["chunk_id"], r["n"]) for r in got] == [("b", 2)]


def test_anchors(spark):
    schema = "h string, path array<string>, a struct<exclude:array<string>,section_prefix:string,all_of:array<string>,any_of:array<string>>"
    rows = [("some warranty text", ["2. Terms"], (["draft"], "2.", ["Warranty"], [])), ("some draft text", [], (["draft"], None, [], [])), ("x", [], ([], None, [], ["y", "X"])), ("x", ["1"], ([], "2", [], []))]
    got = [r["m"] for r in spark.createDataFrame(rows, schema).select(evidence.anchor_matches(F.col("h"), F.col("path"), F.col("a")).alias("m")).collect()]
    assert got == [True, False, True, False]


def test_json_objects(spark):
    rows = [('<think>x</think>```json\n{"a": 1}\n```', '{"a":1}'), ('so: {"a": {"b": 2}} end', '{"a":{"b":2}}'), ("[1]", None), ("no", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, e string").select("e", F.to_json(evidence.json_object(F.col("t"))).alias("j")).collect()
    assert all((r["j"] and json.loads(r["j"])) == (r["e"] and json.loads(r["e"])) for r in got)


def test_embedding_input_keeps_three_parts_of_the_path(spark):
    row = spark.createDataFrame([("product_page", " T ", ["a", "b", "c", "d"], " body ")], "k string, t string, p array<string>, c string").select(tx.embedding_input(F.col("k"), F.col("t"), F.col("p"), F.col("c")).alias("x")).first()
    assert row["x"] == "Document: T\nType: Product Page\nSection: b > c > d\n\nbody"


def test_vector_issues(spark):
    rows = [([1.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), ([2.0, 0.0],)]
    got = [r["i"] for r in spark.createDataFrame(rows, "v array<float>").select(evidence.vector_issues(F.col("v"), 2).alias("i")).collect()]
    assert got[0] == [] and got[1] == ["length"] and "not_finite" in got[2] and got[3] == ["norm"]


def test_hierarchical_chunks(spark):
    """Tables keep their header, long texts break at sentences, long sentences at words, and nothing is lost or too long."""
    from quarryspark.operators import hierarchy

    table = "\n".join(["| name | value |", *[f"| row{i} | {'v' * 20}{i} |" for i in range(40)]])
    prose = " ".join(f"Sentence number {i} says something of note." for i in range(60))
    words = " ".join(f"word{i}" for i in range(200))
    docs = spark.createDataFrame([(1, f"# Part\n\nshort\n\n{table}\n\n## Next\n\n{prose}\n\n{words}"), (2, "# alone"), (3, None)], "doc_id long, text string")
    units = hierarchy.units(blocks.markdown_blocks(docs), docs.select(F.col("doc_id").alias("document_id"), F.lit("Title").alias("title")))
    rows = sorted(hierarchy.hierarchical_chunks(units, 60, 20).collect(), key=lambda r: r["chunk_index"])
    assert {r["document_id"] for r in rows} == {1} and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(r["token_count"] <= 60 for r in rows) and {r["method"] for r in rows} == {"paragraph", "table", "sentence", "hard"}
    assert rows[0]["content"] == "Title > Part\n\nshort"
    tables = [r["content"] for r in rows if r["method"] == "table"]
    assert all(t.startswith("Title > Part\n\n| name | value |\n") for t in tables) and sum(t.count("| row") for t in tables) == 40
    assert " ".join(r["content"].removeprefix("Title > Next\n\n") for r in rows if r["method"] == "sentence") == prose
    hard = " ".join(r["content"].replace("Title > Next", "") for r in rows if r["method"] == "hard").split()
    assert hard == words.split()


def test_slack_and_second_pass():
    from quarryspark.operators import hierarchy

    body = "x" * 200
    assert [m for m, _ in hierarchy.unit_chunks("paragraph", ["a", "b"], body, 51, 5)] == ["paragraph"]  # 52 tokens, a twentieth over
    out = hierarchy.document_chunks([("paragraph", ["a", "b"], "yy " * 66)], 50, 5)
    assert all(len(c) <= 200 for _, _, c in out) and out[0][1] == "hard"  # the second pass cuts what the first let stand
    assert list(hierarchy.ranges([], lambda k: 0, 5)) == [] and list(hierarchy.ranges([100, 1, 1], lambda k: 0, 5)) == [(0, 1), (1, 3)]
