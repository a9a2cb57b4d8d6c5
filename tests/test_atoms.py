"""Atomic units and their sizes against a plain version with Python's patterns; chunks behind their filters."""

import re

import pytest
from pyspark.sql import functions as F
from test_structure_and_turns import same

from quarryspark.operators import atoms, hierarchy

UNITS = "document_id int, ord int, unit_type string, path array<string>, text string"
FAQ = "Intro 1.1 What is it? It is\na thing. 1.2 And this? Yes 2.5 times. 1.3 Empty?  "
CASES = [
    ("paragraph", ["A", "B"], FAQ), ("faq_pair", ["A"], " whole "), ("paragraph", [], "Registered Office here\nand Corporate office"), ("paragraph", ["A"], "Reach us at x"), ("paragraph", ["A"], "Why choose us\n- one two three four\n• five six seven eight\n* short"),
    ("paragraph", ["A"], "why choose\n- one\n- two"), ("paragraph", ["A"], "Size: ten mm\nWeight: 5\nColour: dark red or so"), ("paragraph", ["1.2 X"], "Features: many"), ("paragraph", ["X"], "Features: many"), ("clause", ["X"], " 1.1 the clause "), ("paragraph", ["A"], "- a\n- b\n- c"),
    ("paragraph", ["A"], "- a\n- b"), ("semantic", None, "plain"), ("heading", ["A"], "Title"), ("paragraph", ["A"], " \n"), ("paragraph", ["A"], None), ("paragraph", ["A"], "Size: one\nName: two"), ("table", ["A"], "| a |"),
]


def plain(kind, path, text):
    """The splitters as loops over Python's patterns."""
    path, text, p = path or [], text or "", atoms.Params()
    if not text.strip() or kind == "heading":
        return []
    whole = [text.strip()]
    if kind == "faq_pair":
        return [("faq_pair", path, whole[0])]
    found = [(m[1], m[2].strip(), m[3].strip()) for m in re.finditer(r"(\d+\.\d+)\s+([^?]+\?)\s+(.+?)(?=\d+\.\d+\s+[^?]+\?|$)", text, re.S) if m[3].strip()]
    if found:
        return [("faq_pair", [*path[:-1], f"FAQ {n}"], f"Question: {q}\n\nAnswer: {a}") for n, q, a in found]
    low, lines = text.lower(), [x.strip() for x in text.splitlines() if x.strip()]
    if "registered office" in low and "corporate office" in low:
        return [("company_information", path, whole[0])]
    if any(w in low for w in p.whole_if_any[0][1]):
        return [("contact_information", path, whole[0])]
    bullets = [m[1].strip() for x in lines if (m := re.match(r"[-•*]\s+(.+)$", x))]
    if any(w in low for w in p.benefits):
        gains = [x.lstrip("-•*").strip() for x in lines if x.startswith(("-", "•", "*")) or "—" in x]
        gains = [x for x in gains if len(x.split()) >= 4]
        got = gains if len(gains) >= 2 else bullets if len(bullets) >= 2 else []
        if got:
            return [("product_feature", path, x) for x in got]
    specs = re.findall(r"^([A-Za-z][A-Za-z0-9 /\-]+):\s*(.+)$", text, re.M)
    if len(specs) >= 2 and (got := [(n.strip(), v.strip()) for n, v in specs if len(v.split()) >= 2]):
        return [("product_specification", path, f"{n}: {v}") for n, v in got]
    if ("Features:" in text or "Why " in text or len(text.split()) >= 40) and path and re.search(r"\d+\.\d+", path[-1]):
        return [("product_description", path, whole[0])]
    if kind == "clause":
        return [("policy_clause", path, whole[0])]
    if len(bullets) >= 3:
        return [("product_feature", path, x) for x in bullets]
    return [("paragraph" if kind == "semantic" else kind, path, whole[0])]


def test_splitters_in_their_order(spark):
    rows = [(k, 0, kind, path, text) for k, (kind, path, text) in enumerate(CASES)]
    got = {}
    for r in atoms.atoms(spark.createDataFrame(rows, UNITS)).orderBy("document_id", "k").collect():
        got.setdefault(r["document_id"], []).append((r["atom_type"], r["path"], r["content"]))
    for k, case in enumerate(CASES):
        assert got.get(k, []) == plain(*case), case
    assert atoms.atoms(spark.createDataFrame([], UNITS)).count() == 0


def tokens(text):
    return max(1, int(len(text) / 4 + 0.999)) if text.strip() else 0


def heading_only(text):
    own = text.strip()
    return not own or (tokens(own) <= 12 and not own.endswith((".", "?", "!")) and (own == own.title() or re.match(r"\d+(?:\.\d+)+\s+.+", own) is not None))


def packed(text, target, most):
    parts, now = [], ""
    for paragraph in [x.strip() for x in re.split(r"\n\s*\n", text) if x.strip()]:
        both = f"{now}\n\n{paragraph}" if now else paragraph
        if tokens(both) <= target:
            now = both
            continue
        parts += [now] if now else []
        if tokens(paragraph) <= most:
            now = paragraph
            continue
        now = ""
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            both = f"{now} {sentence}" if now else sentence
            if tokens(both) <= target:
                now = both
            else:
                parts += [now] if now else []
                now = sentence
    return parts + ([now] if now else [])


def test_sizes_are_enforced(spark):
    word = lambda n: " ".join(["word"] * n)
    texts = ["A Title", "1.2 some clause", "A Title.", "not a title", "ÉCOLE", "École De", "x's", word(20), "\n\n".join([word(12), word(9), word(30), word(3)]), f"{word(6)}. {word(8)}! {word(40)}? {word(5)}", f"Head Line\n\n{word(60)}", word(100), "\n\n".join(["Only Heads"] * 20), ""]
    rows = [(k, 0, "paragraph", ["A"], t) for k, t in enumerate(texts)]
    found = atoms.enforced(atoms.atoms(spark.createDataFrame(rows, UNITS), atoms.Params(whole_if_any=())), target=15, most=25).orderBy("document_id", "i").collect()
    got = {}
    for r in found:
        got.setdefault(r["document_id"], []).append(r["content"])
        assert r["token_count"] == tokens(r["content"])
    for k, t in enumerate(texts):
        own = t.strip()
        want = [] if heading_only(own) else [own] if tokens(own) <= 25 else [x for x in packed(own, 15, 25) if not heading_only(x)]
        assert got.get(k, []) == want, t


def test_every_dropped_chunk_has_a_row(spark):
    rows = [(1, 0, ["A"], "paragraph", "Some  Text here."), (1, 1, ["A"], "paragraph", "some text here."), (1, 2, ["B"], "paragraph", "Some text here."), (1, 3, ["A"], "paragraph", "- 12"), (1, 4, ["A"], "paragraph", "- 12"), (1, 5, ["A"], "hard", "the tail"), (1, 6, ["A"], "paragraph", "This page is left blank"), (1, 7, ["A"], "paragraph", "This page is  left blank"), (2, 0, ["A"], "paragraph", "Some text here.")]
    chunks = spark.createDataFrame(rows, "document_id int, chunk_index int, path array<string>, method string, content string").withColumn("chunk_id", F.concat("document_id", F.lit("-"), "chunk_index")).withColumn("token_count", (F.length("content") / 4).cast("long"))
    kept, gone = hierarchy.filtered(chunks)
    assert sorted((r["document_id"], r["chunk_index"], r["content"]) for r in kept.collect()) == [(1, 0, "Some  Text here."), (1, 1, "Some text here."), (1, 2, "This page is left blank"), (2, 0, "Some text here.")]
    assert sorted((r["chunk_index"], r["reason"], r["detail"]) for r in gone.collect()) == [
        (1, "same_context_duplicate", "duplicate_of=1-0"), (3, "standalone_low_value", "numeric_list_debris"), (4, "standalone_low_value", "numeric_list_debris"), (5, "context_noise", "hard_split_orphan_tail"), (7, "boilerplate", "duplicate_of=1-6"),
    ]


@pytest.mark.parametrize("name", ["atomic_units"])
def test_queries_are_their_sql(spark, name):
    same(spark, name)
