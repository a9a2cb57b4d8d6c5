"""Anchors, needles, fuzzy names, JSON sources and versions: small cases against their rules, crashes and conflicts."""

from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.operators import anchors as an
from quarryspark.operators import fuzzy
from quarryspark.sources import json_files, snapshots

from test_structure_and_turns import same

CHUNK = "chunk_id string, document_id string, content string, path array<string>, content_type string, token_count int"
ANCHOR = "knowledge_key string, document_id string, content_type string, section_prefix string, all_of array<string>, any_of array<string>, excludes array<string>, only_marker string, preferred_marker string"
CHUNKS = [
    ("c1", "d1", "The warranty is two Years", ["1. Terms"], "text", 9), ("c2", "d1", "warranty of one year", ["2. Other"], "text", 5), ("c3", "d2", "Warranty summary years", ["Catalog Summary"], "section_summary", 7),
    ("c4", "d2", None, None, None, 1), ("c5", "d3", "years ago", ["1. Terms", "x"], "text", None),
]


ASKED = [
    ({"all_of": ["WARRANTY", "year"]}, ["c2", "c3", "c1"]), ({"all_of": ["warranty"], "excludes": ["one"]}, ["c3", "c1"]), ({"all_of": ["warranty", "absent"]}, []),
    ({"any_of": ["absent", "two years", "ago"]}, ["c5", "c1"]),  # no count of tokens comes first
    ({"all_of": ["year"], "any_of": ["absent"]}, []), ({"all_of": ["year"], "section_prefix": "1."}, ["c5", "c1"]), ({"all_of": ["terms"], "document_id": "d3"}, ["c5"]), ({"all_of": ["", None, "year"], "content_type": "section_summary"}, ["c3"]),
    ({"document_id": "d2"}, ["c4", "c3"]), ({}, []), ({"all_of": ["warranty"], "only_marker": "catalog summary"}, ["c3"]), ({"all_of": ["warranty"], "only_marker": "no such path"}, ["c2", "c3", "c1"]), ({"all_of": ["warranty"], "preferred_marker": "SUMMARY"}, ["c3"]),
]


@pytest.mark.parametrize("part", [16 << 20, 40])
def test_conditions_of_an_anchor(spark, monkeypatch, part):
    monkeypatch.setattr(an, "PART_CHARS", part)  # 40: a few literals an automaton
    empty = dict.fromkeys(c.split()[0] for c in ANCHOR.split(", "))
    asked = spark.createDataFrame([empty | {"knowledge_key": f"k{k}"} | own for k, (own, _) in enumerate(ASKED)], ANCHOR)
    resolved, expected = an.resolve_anchors(asked, an.matches(asked, spark.createDataFrame(CHUNKS, CHUNK)))
    found = {}
    for r in expected.orderBy("knowledge_key", "rank").collect():
        found.setdefault(r["knowledge_key"], []).append(r["chunk_id"])
    states = {r["knowledge_key"]: (r["answerability"], r["n_chunks"], r["best_chunk_id"]) for r in resolved.collect()}
    for k, (own, want) in enumerate(ASKED):
        assert found.get(f"k{k}", []) == want, own
        assert states[f"k{k}"] == (an.ANSWERABLE if want else an.GAP, len(want), want[0] if want else None)


def test_anchors_without_chunks(spark):
    asked, none = spark.createDataFrame([("k", None, None, None, ["a"], None, None, None, None)], ANCHOR), spark.createDataFrame([], CHUNK)
    resolved, expected = an.resolve_anchors(asked, an.matches(asked, none))
    assert resolved.first()["answerability"] == an.GAP and expected.count() == 0


def test_needles(spark):
    chunks = spark.createDataFrame(CHUNKS, CHUNK)
    rows = [(1, None, None, ["warranty", "YEAR"], False), (2, None, None, ["warranty", "year"], True), (3, None, None, ["two", "ago"], False), (4, None, None, ["two", "absent"], False), (5, "d2", None, ["years"], False), (6, None, None, [], False), (7, None, "section_summary", ["one"], False), (8, None, None, ["two", "Two", None], None)]
    got = an.expected_by_needles(spark.createDataFrame(rows, "question_id int, document_id string, content_type string, needles array<string>, single boolean"), chunks)
    assert sorted(map(tuple, got.collect())) == [(1, "c1", False), (1, "c2", False), (1, "c3", False), (2, "c1", True), (3, "c1", True), (3, "c5", True), (5, "c3", False), (8, "c1", False)]


def test_golden_matches(spark):
    rows = [("a", "d1", ["one", "two"], None), ("b", "d1", ["absent"], "1"), ("c", "d1", ["absent"], None), ("d", "d1", ["one"], "2"), ("e", "d9", ["one"], None)]
    got = an.golden_matches(spark.createDataFrame(rows, "concept_id string, document_id string, patterns array<string>, section string"), spark.createDataFrame(CHUNKS, CHUNK))
    assert sorted((r["concept_id"], r["chunk_id"], r["matched_pattern"]) for r in got.collect()) == [("a", "c1", "two"), ("b", "c1", "absent"), ("d", "c2", "one")]


# --- fuzzy names


@pytest.mark.parametrize("ratio", [None, 0.86, 0.8])
def test_near_names_are_those_of_all_pairs(spark, ratio):
    r = np.random.default_rng(5)
    letters = list("abcde")
    names = {"".join(r.choice(letters, int(r.integers(3, 14)))) for _ in range(40)}
    words = {"".join(r.choice(letters, int(r.integers(3, 14)))) for _ in range(150)}
    for n in list(names):
        k = int(r.integers(len(n)))
        words |= {n, n[:k] + n[k + 1 :], n[:k] + "x" + n[k:], n[:k] + "zz" + n[k + 1 :], n + n[0]}
    got = {(p["word"], p["name"]) for p in fuzzy.pairs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), ratio).collect()}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = lambda w, n: SequenceMatcher(None, w, n).ratio() >= ratio if ratio else edits(w, n) <= (1 if min(len(w), len(n)) < 8 else 2)
    assert got == {(w, n) for w in words for n in names if w != n and min(len(w), len(n)) >= 4 and near(w, n)}


def test_routed_messages(spark):
    names = spark.createDataFrame([("Radius 16", 0), ("Radius", 1), ("TINY", 2)], "name string, place int")
    fixes = spark.createDataFrame([("tinny", "TINY", 0.96, True), ("warrenty", "warranty", 0.95, False)], "word string, replacement string, sure double, is_name boolean")
    rows = [(1, "raduis warrenty", None), (2, "what is its price?", "TINY"), (3, "price", "TINY"), (4, "Tinny and radius 16", "TINY"), (5, "+91 98765 43210", "TINY"), (6, None, "TINY"), (7, "all products price", "TINY"), (8, "is it good", "A$1\\x"), (9, "radios price", "TINY")]
    got = {r["message_id"]: (r["rewritten"], r["confidence"], r["entities"]) for r in fuzzy.routed(spark.createDataFrame(rows, "message_id int, text string, product string"), names, fixes).collect()}
    assert got == {
        1: ("raduis warranty", 0.95, []), 2: ("what is the price of TINY?", 0.92, ["TINY"]), 3: ("price of TINY?", 0.92, ["TINY"]), 4: ("TINY and radius 16", 0.96, ["Radius 16", "TINY"]), 5: ("+91 98765 43210", 1.0, []),
        6: ("", 1.0, []), 7: ("all products price", 1.0, []), 8: ("is A$1\\x good", 0.92, ["A$1\\x"]), 9: ("radios price of TINY?", 0.92, ["TINY"]),
    }
    near = fuzzy.routed(spark.createDataFrame([(1, "radiuss price", None)], "message_id int, text string, product string"), names, fixes).first()
    assert (near["rewritten"], near["confidence"], near["entities"]) == ("Radius price", 0.9, ["Radius"])


# --- sources


def test_json_lines_are_accounted_for(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"id": 1, "v": "é"}\n{"id": 2\n\n{"v": "no id"}\n[1]\n')
    (tmp_path / "y.json").write_text('{"id": "text", "v": 3}\n{"id": 4, "more": {"k": 1}}\n')
    (tmp_path / "z.txt").write_text("not read")
    rows = json_files.read(spark, str(tmp_path), "id long, v string", pattern="*.json")
    got = {r["_file"].rsplit("/", 1)[1]: (r["n_rows"], r["n_corrupt"], r["n_without_key"], r["n_loaded"]) for r in json_files.accounted(rows, ["id"]).collect()}
    assert got == {"x.json": (4, 2, 1, 1), "y.json": (2, 1, 0, 1)}


def test_documents_of_a_file_each(spark, tmp_path):
    for name, body in {"good": '{"count": 2,\n "conversations": [{"conversation_id": "a"}, {"conversation_id": "b"}]}', "count": '{"count": 3, "conversations": [{"conversation_id": "a"}, {"conversation_id": "a"}]}', "broken": '{"count": '}.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows = json_files.read(spark, str(tmp_path), "count int, conversations array<struct<conversation_id:string>>", whole_files=True)
    assert sorted((r["_file"].rsplit("/", 1)[1], r["issue"], r["n"]) for r in json_files.dataset_issues(rows).collect()) == [("broken.json", "corrupt", 1), ("count.json", "count", 2), ("count.json", "repeated_id", 1)]


def test_a_run_goes_on_where_it_was_cut(spark, tmp_path):
    at = f"{tmp_path}/results"
    json_files.append(spark.createDataFrame([(1, 1, "old"), (2, 1, "x")], "id int, run int, v string"), at)
    json_files.append(spark.createDataFrame([(1, 2, "new")], "id int, run int, v string"), at)
    (tmp_path / "results" / "cut.json").write_text('{"id": 3, "run"')
    done = json_files.completed(json_files.read(spark, at, "id int, run int, v string"), "id", "run")
    assert sorted(map(tuple, done.collect())) == [(1, 2, "new"), (2, 1, "x")]
    assert [r["id"] for r in json_files.pending(spark.createDataFrame([(1,), (3,), (4,)], "id int"), done, "id").orderBy("id").collect()] == [3, 4]
    with pytest.raises(ValueError, match="only 2"):
        json_files.first_by_id(done, 3, "id")


def test_a_lost_job_leaves_the_version_as_it_was(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "id int, v string")
    assert snapshots.create(rows, root, ["id"], buckets=4) == 1

    @F.udf("string")
    def fails(v):
        raise RuntimeError("the executor is lost")

    with pytest.raises(Exception, match="lost"):
        snapshots.upsert(spark, root, rows.withColumn("v", fails("v")))
    assert snapshots.versions(spark, root) == [1] and snapshots.read(spark, root).count() == 50
    left = len(snapshots.unnamed(spark, root))
    snapshots._staged(rows, root, ["id"], 4)  # a writer that is lost between its files and the log
    assert len(snapshots.unnamed(spark, root)) == left + 1 and snapshots.read(spark, root).count() == 50
    assert snapshots.upsert(spark, root, rows.where("id < 3").withColumn("v", F.lit("new"))) == 2
    assert {r["id"] for r in snapshots.read(spark, root).where("v = 'new'").collect()} == {0, 1, 2}
    assert snapshots.read(spark, root, 1).where("v = 'new'").count() == 0


def test_two_writers_conflict(spark, tmp_path):
    root = f"{tmp_path}/t"
    rows = spark.createDataFrame([(k, "v") for k in range(20)], "id int, v string")
    snapshots.create(rows, root, ["id"])
    snapshots.delete(spark, root, rows.where("id < 5"), base=1)
    with pytest.raises(snapshots.Conflict):
        snapshots.delete(spark, root, rows.where("id > 10"), base=1)
    with pytest.raises(snapshots.Conflict):
        snapshots.create(rows, root, ["id"])
    assert sorted(r["id"] for r in snapshots.read(spark, root).collect()) == list(range(5, 20))
    assert snapshots.append_new(spark, root, rows.where("id in (1, 7)").withColumn("v", F.lit("w"))) == 3
    assert {(r["id"], r["v"]) for r in snapshots.read(spark, root).where("id in (1, 7)").collect()} == {(1, "w"), (7, "v")}
    assert snapshots.restore(spark, root, 1) == 4 and snapshots.read(spark, root).count() == 20
    assert [r["n_rows"] for r in snapshots.history(spark, root).orderBy("version").collect()] == [20, 15, 16, 20]
    with pytest.raises(KeyError):
        snapshots.read(spark, root, 9)


def test_changes_leave_other_buckets_alone(spark, tmp_path):
    root = f"{tmp_path}/t"
    rows = spark.createDataFrame([(k, "v") for k in range(64)], "id int, v string")
    snapshots.create(rows, root, ["id"], buckets=8)
    before = snapshots.entry(spark, root)["buckets"]
    snapshots.upsert(spark, root, rows.where("id = 11"))
    after = snapshots.entry(spark, root)["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1
    empty = f"{tmp_path}/e"
    snapshots.create(rows.limit(0), empty, ["id"])
    assert snapshots.read(spark, empty).count() == 0 and snapshots.upsert(spark, empty, rows) == 2


def test_corpora_by_name(spark, tmp_path):
    root = f"{tmp_path}/t"
    snapshots.create(spark.createDataFrame([(1, "a")], "id int, v string"), root, ["id"])
    known = snapshots.Registry()
    known.register_snapshot("v1", root, 1)
    assert known.load(spark, "v1").count() == 1 and known.names() == ["v1"]
    with pytest.raises(KeyError, match="registered"):
        known.load(spark, "v2")


@pytest.mark.parametrize("name", ["resolved_anchors", "needle_chunks", "fuzzy_names", "json_pages", "manifest_issues", "snapshot_versions"])
def test_queries_are_their_sql(spark, name):
    same(spark, name)
