"""Lines repeated over pages, reports in one pass, and digest trees."""

import pytest
from pyspark.sql import functions as F
from test_structure_and_turns import same

from quarryspark.operators import digests, pages, reports

PAGES = [(1, 1, "Head\nFIRST PART (A)\none two\n\nmore\nPage 1"), (1, 2, " Head \nonly here\nPage 2"), (1, 3, "other\nHead\nHead"), (1, 4, None), (2, 1, "Head\nHead"), (3, 1, "a\nb"), (3, 2, "a"), (None, 1, "x"), (4, 1, "d"), (4, 1, "d")]


def test_repeated_lines_of_a_document(spark):
    df = spark.createDataFrame(PAGES, "document_id int, page int, text string")
    got = {(r["document_id"], r["line"], r["n"], r["n_pages"]) for r in pages.repeated_lines(df).collect()}
    assert got == {(1, "Head", 4, 4), (3, "a", 2, 2), (4, "d", 2, 2)}
    clean = {(r["document_id"], r["page"]): (r["text"], r["removed"]) for r in pages.without_repeated(df, pages.repeated_lines(df), (r"^Page \d+$",)).collect()}
    assert clean[1, 1] == ("FIRST PART (A)\none two\n\nmore", ["Head", "Page 1"]) and clean[1, 3] == ("other", ["Head", "Head"]) and clean[1, 4] == ("", [])
    assert clean[2, 1] == ("Head\nHead", []) and clean[3, 1] == ("b", ["a"]) and clean[None, 1] == ("x", [])
    assert pages.repeated_lines(df.limit(0)).count() == 0


def test_blocks_of_a_page(spark):
    df = spark.createDataFrame([(1, 1, "FIRST PART\none\ntwo\n\nthree\nA B C D E F G H I J K L M\nTAIL"), (1, 2, ""), (1, 3, None)], "document_id int, page int, text string")
    got = [(r["page"], r["ord"], r["node_type"], r["text"]) for r in pages.page_blocks(df).orderBy("page", "ord").collect()]
    assert got == [(1, 0, "heading", "FIRST PART"), (1, 1, "paragraph", "one\ntwo"), (1, 2, "paragraph", "three\nA B C D E F G H I J K L M"), (1, 3, "heading", "TAIL"), (2, 0, "paragraph", ""), (3, 0, "paragraph", "")]


def test_groupings_share_one_shuffle(spark):
    rows = spark.createDataFrame([(k, f"s{k % 3}", "pdf" if k % 2 else "html") for k in range(3000)], "document_id int, website string, source_type string")
    found = reports.by_groupings(rows, [("website",), ("website", "source_type"), ()], {"most": F.max("document_id")}, "document_id")
    got = {(r["grouping"], r["website"], r["source_type"]): r for r in found.collect()}
    assert got["all", None, None]["n"] == 3000 and got["website", "s1", None]["n"] == 1000 and got["website+source_type", "s1", "pdf"]["n"] == 500
    assert abs(got["all", None, None]["n_distinct"] - 3000) < 100
    merged = found.where("grouping = 'website'").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).first()["n"]
    assert abs(merged - 3000) < 100
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_gates_of_a_diagnosis(spark):
    schema = "category string, answerability string, passed_at_5 boolean, passed_at_10 boolean, root_cause string, document_rank int"
    rows = [("SUMMARY", "ANSWERABLE", True, True, None, 1), ("SUMMARY", None, False, True, None, 7), ("PRODUCT", "ANSWERABLE", True, True, None, 2), ("PRODUCT", "ANSWERABLE", None, False, "EMBEDDING_REPRESENTATION", None), ("PRODUCT", "CORPUS_GAP", None, None, "CORPUS_GAP", None)]
    found = reports.diagnosis(spark.createDataFrame(rows, schema))
    total = found.where("category is null").first()
    assert (total["n"], total["n_answerable"], total["n_gaps"], total["pass_at_5_rate"], total["document_at_10_rate"], total["n_failed"]) == (5, 4, 1, 0.5, 0.75, 1)
    assert reports.verdicts(found).first().asDict() == {"chunking_quality": "GOOD", "retrieval_quality": "NEEDS_IMPROVEMENT", "summary_representation": "NEEDS_IMPROVEMENT", "corpus_quality": "GOOD", "embedding_model": "INVESTIGATE"}
    worse = reports.verdicts(reports.diagnosis(spark.createDataFrame([("SUMMARY", "ANSWERABLE", True, False, "CHUNK_GRANULARITY", 1)] * 3 + [("X", "CORPUS_GAP", None, None, None, None)] * 5, schema))).first()
    assert (worse["chunking_quality"], worse["retrieval_quality"], worse["summary_representation"], worse["corpus_quality"], worse["embedding_model"]) == ("NEEDS_IMPROVEMENT", "GOOD", "GOOD", "NEEDS_IMPROVEMENT", "DO_NOT_CHANGE")
    assert reports.verdicts(reports.diagnosis(spark.createDataFrame([], schema))).count() == 1


def test_only_changed_ranges_are_read(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(400)], "id int, v string")
    other = rows.withColumn("v", F.when(F.col("id") == 17, "new").otherwise(F.col("v")))
    made = [digests.freeze(df, f"{tmp_path}/{name}", "id", ["v"]) for name, df in (("a", rows), ("b", other), ("c", rows.repartition(7).orderBy(F.desc("id"))))]
    a, b, c = (digests.frozen_tree(spark, f"{tmp_path}/{n}") for n in "abc")
    assert made[0] == made[2] and made[0]["digest"] != made[1]["digest"] and made[0]["n"] == 400
    assert digests.unchanged(a, c).first()["unchanged"] and not digests.unchanged(a, b).first()["unchanged"]
    assert digests.changed_leaves(a, c) == []
    names = digests.changed_leaves(a, b)
    assert len(names) == 1
    found = [digests.leaves(spark, f"{tmp_path}/{n}", names, rows) for n in "ab"]
    read = found[0].inputFiles()
    assert all(f"/leaf={names[0]}/" in f for f in read) or found[0]._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [") >= 1
    assert found[0].count() < 20
    assert [tuple(r) for r in digests.changes(*found, "id", ["v"]).collect()] == [(17, "changed")]
    with pytest.raises(Exception, match="exists"):
        digests.freeze(rows, f"{tmp_path}/a", "id", ["v"])


def test_rows_that_run_together_differ(spark):
    marks = spark.createDataFrame([(1, "ab", "c"), (1, "a", "bc"), (1, None, "c"), (1, "", "c"), (1, "-", "c")], "id int, a string, b string").select(digests.row_mark(["id", "a", "b"]).alias("m"))
    assert marks.distinct().count() == 5
    empty = digests.tree(spark.createDataFrame([], "id int, v string"), "id", ["v"])
    assert empty.count() == 0 and digests.unchanged(empty, empty).count() == 0


@pytest.mark.parametrize("name", ["page_repeats", "cleaned_pages", "page_blocks", "audit_summary", "diagnosis_by_category", "digest_tree"])
def test_queries_are_their_sql(spark, name):
    same(spark, name)
