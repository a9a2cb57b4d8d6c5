"""Near duplicates, vectors, components, mixing and the pipeline against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarryspark.llm import embedding_dedup, mixing, near_dup
from quarryspark.llm.components import components


def reached(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text, k):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def families():
    """Copies with more and more words changed, as chains; short, empty and repeated texts."""
    r = np.random.default_rng(5)
    rows, n = [], 0
    for _ in range(12):
        words = [f"w{int(i)}" for i in r.integers(0, 5000, 120)]
        for _ in range(14):
            rows.append((n, " ".join(words)))
            n += 1
            words[int(r.integers(0, 120))] = f"x{int(r.integers(0, 10**6))}"
            if r.random() < 0.3:
                words[int(r.integers(0, 120))] = "y"
    rows += [(n, "one two"), (n + 1, "ONE\ttwo"), (n + 2, None), (n + 3, ""), (n + 4, "one"), (n + 5, rows[3][1]), (n + 6, rows[3][1])]
    order = r.permutation(len(rows))
    return [(int(order[i]), t) for i, (_, t) in enumerate(rows)]


def test_repeated_ids_join_the_links_of_their_rows(spark):
    """An id with several texts is one node, also where it is the first of its group."""
    r = np.random.default_rng(6)
    a, b, c = ([f"w{int(i)}" for i in r.integers(0, 5000, 100)] for _ in range(3))
    near = lambda w: " ".join(["other", *w[1:]])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (3, near(b)), (1, " ".join(c)), (5, near(c)), (6, "alone " * 5), (3, near(b))]
    got = {x["doc_id"]: x["component_id"] for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.Params(3, 85)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 6: 6}


def test_clashing_columns_long_texts_and_empty_tables(spark, tmp_path):
    """Columns named like those within, a very long text, and no rows, for near duplicates, vectors, mixing and the pipeline."""
    clash = ("node", "component", "sig", "rep", "linked", "kept", "id", "n", "band", "salt")
    long = " ".join(f"w{k}" for k in range(100_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, None), (3, None)], "doc_id long, text string")
    for name in clash:
        docs = docs.withColumn(name, F.lit("x"))
    assert {(r["doc_id"], r["component_id"]) for r in near_dup.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}
    assert near_dup.kept_documents(docs).columns == docs.columns and near_dup.kept_documents(docs).count() == 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("v", F.lit(2)).withColumn("cell", F.lit(3))
    assert {(r["vec_id"], r["component_id"], r["n_links"]) for r in embedding_dedup.near_vectors(vectors).collect()} == {(1, 1, 1), (2, 1, 1)}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("words", "percent", "chunk"), [(3, 85, 2048), (5, 80, 8)])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, words, percent, chunk):
    monkeypatch.setattr(near_dup, "CHUNK_ROWS", chunk)  # 8: large groups are dealt out as pairs of chunks
    rows = families()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, near_dup.Params(words, percent)).collect()}
    sets = {i: shingle_set(t, words) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= percent * len(sets[a] | sets[b])]
    want = reached(list(sets), pairs)
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(want) - 20


def test_near_duplicates_bear_null_ids_empty_tables_and_clashes(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l m"), (2, "a b c d e f")], "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted(map(tuple, near_dup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert near_dup.kept_documents(docs).columns == docs.columns and near_dup.kept_documents(docs).count() == 3
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    r = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long"), "a", "b").collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {k: v for k, v in reached({x for p in pairs for x in p}, pairs).items() if k in nodes}


@pytest.mark.parametrize("chunk", [8192, 16])
def test_vectors_are_those_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", chunk)  # 16: many cells and chunks
    r = np.random.default_rng(7)
    centres = r.standard_normal((9, 8))
    v = [(centres[int(r.integers(9))] + 0.25 * r.standard_normal(8)).astype(np.float32).tolist() for _ in range(150)]
    v += [v[3], v[3], [0.0] * 8, None, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, [1.0, 2.0], []]
    rows = [(int(i), x) for i, x in zip(r.permutation(len(v)), v, strict=True)]
    df = spark.createDataFrame([*rows, (None, v[3])], "vec_id long, embedding array<float>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embedding_dedup.near_vectors(df).collect()}
    sound = {i: np.array(x, float) for i, x in rows if x and None not in x and np.isfinite(x).all() and any(x)}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b)) if len(a) == len(b) else 0
    pairs = [(a, b) for a in sound for b in sound if a < b and cos(sound[a], sound[b]) >= 0.95]
    want = reached([i for i, _ in rows], pairs)
    n = {i: sum(i in p for p in pairs) for i, _ in rows}
    assert got == {i: (n[i], want[i], want[i] == i) for i, _ in rows} | {None: (0, None, True)}
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_cells_and_blocks_save_comparisons(spark):
    """Every table has several cells; pivots lie apart; blocks leave out most pairs of clustered vectors, and none that is
    near."""
    r = np.random.default_rng(3)
    for sf in ("sf0.001", "sf0.01"):
        v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        assert min(embedding_dedup.FEW_PIVOTS, v.count() // embedding_dedup.ROWS_A_PIVOT) > 1
    centres = r.standard_normal((20, 4))
    u = np.concatenate([c + 0.02 * r.standard_normal((200, 4)) for c in centres])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    pivots = embedding_dedup.apart(u, 6)
    assert ((pivots[:, None] - pivots[None]) ** 2).sum(2)[np.triu_indices(6, 1)].min() > 0.5
    radius = embedding_dedup.Params().radius
    for cross, split in ((False, 4000), (True, 1500)):
        side = r.permutation(4000) >= split if cross else np.zeros(4000, bool)
        far = np.sqrt(((u - pivots[1]) ** 2).sum(1))
        order = np.lexsort((far, side))
        w, far = u[order], far[order]
        seen = np.zeros((4000, 4000), bool)
        for x, y in embedding_dedup.blocks(far, split, cross, radius):
            assert not seen[x, y].any()
            seen[x, y] = True
        near = np.triu(w @ w.T >= 0.95, 1)
        if cross:
            near[:split, :split] = near[split:, split:] = False
        assert (seen >= near).all() and near.sum() > 1000
        assert seen.sum() < 0.9 * (split * (4000 - split) if cross else 4000 * 4000 / 2)


def mix_rows():
    r = np.random.default_rng(11)
    names = [("src0", "en")] * 6 + [("src1", "en"), ("src1", "de"), ("src2", "fr"), ("src5", "en"), ("src6", "es")]
    rows = [(k, " ".join(["w"] * int(r.integers(0, 60))), *names[int(r.integers(len(names)))][::-1]) for k in range(400)]
    return [*rows, (400, None, "en", "src0"), (401, "", None, None), (402, "a b", None, "src1"), (403, "a", "en", None)]


def test_mixing_equals_sql(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, lang string, source string")
    got = mixing.op10_mixing(docs).toPandas()
    con = duckdb.connect()
    con.register("d", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT * FROM d")
    want = con.execute(mixing.ORACLE).df()
    cols = sorted(want.columns)
    a, b = (sorted(map(tuple, x[cols].astype(str).values.tolist())) for x in (got, want))
    assert a == b


def test_mixing_keeps_to_the_budget_and_shares_shortages_among_siblings(spark):
    rows = [(k, "w " * 10, "en", "a" if k < 5 else "b") for k in range(100)] + [(k, "w " * 10, "de", "c") for k in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("domain", F.lit("d"))
    p = mixing.Params({"lang": {"en": 1, "de": 1}, "source": {"a": 9, "b": 1}}, budget=1000, epochs=1)
    got = {(r["lang"], r["source"]): (r["budget"], r["n"]) for r in mixing.mixed(docs, p).groupBy("lang", "source").agg(F.first("budget").alias("budget"), F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    assert got == {("en", "a"): (50, 50), ("en", "b"): (450, 450), ("de", "c"): (500, 500)}
    assert mixing.mixed(docs.limit(0), p).count() == 0


def test_mixture_takes_rows_as_often_as_epochs(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s"), (2, "c d", "en", "s")], "doc_id long, text string, lang string, source string").withColumn("_copies", F.lit(9)).withColumn("domain", F.lit("own"))
    p = mixing.Params(budget=6, epochs=3)
    got = mixing.mixture(docs, p, {"domain": F.lit("x"), "lang": F.col("lang"), "source": F.col("source")})
    assert got.columns == docs.columns and got.count() == 3 and {r["domain"] for r in got.collect()} == {"own"}


def test_pipeline_stages_follow_from_each_other(spark, tmp_path):
    """Each stage on what the one before kept, against what brute force says of its input."""
    r = np.random.default_rng(13)
    word = lambda a: "".join(r.choice(list(a), int(r.integers(2, 9))))
    rows = []
    for k in range(160):
        lang, letters = [("xx", "abcdef"), ("yy", "uvwxyz")][k % 2]
        rows.append((k, " ".join(word(letters) for _ in range(60)), lang, f"src{k % 5}", 0))
    rows += [(200, rows[0][1], "xx", "src1", 0), (201, rows[1][1].replace(" ", "  "), "yy", "src1", 0), (202, rows[2][1] + " abc", "xx", "src1", 0), (203, "12 !!", "xx", "src1", 0), (204, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "byte_bpe":
            assert at.columns == docs.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x["doc_id"] for x in at.select("doc_id").collect()}
    everyone = {x[0] for x in rows}
    assert kept["language_id"] == everyone - {203, 204}
    assert kept["exact_dedup"] == kept["language_id"] - {200, 201}
    assert kept["minhash"] == kept["exact_dedup"] - {202}
    assert kept["mixing"] < kept["minhash"] and kept["byte_bpe"] == kept["mixing"]
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept["byte_bpe"]
