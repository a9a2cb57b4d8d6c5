"""Quality, collocations and clustering against brute force, on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryspark.llm import clustering, collocations, quality

# --- collocations


def plain_phrases(rows, p):
    """The contract, word for word, in dictionaries and Python integers."""
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, p.words + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {w: a for w, a in f.items() if len(w) >= 2 and a >= p.least}
        best = []
        for w, a in candidates.items():
            inside = [b for v, b in candidates.items() if len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))]
            if any(100 * b >= p.percent * a for b in inside):
                continue
            score, _, l, r = min((10**6 * a * a // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            best.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, w, l, r) in enumerate(sorted(best)[: p.top], 1):
            out.append((lang, rank, w.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def some_texts():
    rng = np.random.default_rng(3)
    words = ["New", "york", "city", "the", "of", "état", "a b", "İx", "z\x1cq", "漢字", "word"]
    rows = []
    for k in range(160):
        picked = rng.choice(words, rng.integers(0, 60), p=[0.2, 0.15, 0.1, 0.15, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!? "], p=[0.6, 0.05, 0.05, 0.1, 0.05, 0.05, 0.02, 0.04, 0.04]) for w in picked)
        rows.append((["en", "fr", None, "en"][k % 4], text))
    long = " ".join(["new york city of"] * 3000)
    return [*rows, ("en", None), ("de", None), ("en", ""), ("fr", " \t.. "), ("en", long), ("en", long), ("en", rows[0][1]), ("en", rows[0][1]), ("", "a b " * 12)]


@pytest.mark.parametrize(("shard", "slots"), [(2_000_000, 26), (50, 20), (50, 3)])
def test_collocations_are_those_of_the_contract(spark, monkeypatch, shard, slots):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    rows = some_texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumn("phrase", F.lit("x")).withColumn("a", F.lit(1)).withColumn("doc_id", F.lit(None).cast("long"))
    got = collocations.op12_collocations(docs, collocations.Params(slots=slots))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, collocations.Params())
    assert collocations.op12_collocations(docs.limit(0)).count() == 0


def test_longer_phrases_and_their_surroundings(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_WORDS", 400)
    rows, p = some_texts(), collocations.Params(words=4, least=3, percent=60, top=50)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    counts = collocations.phrase_counts(docs, p)
    got = collocations.collocations(counts, p)
    assert sorted(tuple(r)[:8] for r in got.collect()) == plain_phrases(rows, p)
    want = {}
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    w = want.setdefault((lang or ("und" if lang is None else ""), " ".join(words[i : i + m])), [0, 0, 0])
                    w[0], w[1], w[2] = w[0] + 1, w[1] + (i > 0), w[2] + (i + m < len(words))
    found = {(r["lang"], r["phrase"]): [r["a"], r["left_words"], r["right_words"]] for r in counts.collect() if r["phrase"]}
    assert found == {k: v for k, v in want.items() if v[0] >= 3}


def test_intervals_of_random_sequences():
    rng = np.random.default_rng(5)
    for n, most, depth in ((60, 3, 5), (400, 40, 3), (300, 2, 7), (200, 2**21, 4)):
        t = np.concatenate([[0], rng.integers(0, most, n), [0]]).astype(np.int32)
        names, before = {}, {}
        for m, level in enumerate(collocations.phrases(t, depth), 1):
            names = {k: (int(w), *before.get(int(r), ())) for k, (w, r) in enumerate(zip(level.word, level.rest, strict=True))}
            want = Counter(tuple(t[i : i + m].tolist()) for i in range(len(t) - m + 1) if (t[i : i + m] > 0).all())
            assert {names[k]: int(c) for k, c in enumerate(level.count)} == want
            before = names


# --- clustering


def plain_clusters(rows, p):
    kept = [(i, [math.floor(p.scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == p.dim and all(x is not None and math.isfinite(x) and abs(x) < 2**17 for x in v)]
    digest = lambda i: hashlib.sha256(f"{p.seed}{i}".encode()).hexdigest()
    centres = [v for _, v in sorted((x for x in kept if x[0] is not None), key=lambda x: (digest(x[0]), x[1]))[: p.k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [min((distance(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
    for _ in range(p.rounds):
        own = nearest()
        for j in range(len(centres)):
            members = [v for (_, v), (_, k) in zip(kept, own, strict=True) if k == j]
            if members:
                centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = nearest()
    per = Counter()
    for d, j in own:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, per[j], sum(per.values()), sha[j]) for (i, _), (d, j) in zip(kept, own, strict=True)), key=str)


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    blobs = rng.standard_normal((5, dim))
    return [(k, (blobs[k % 5] * (k % 3) + 0.7 * rng.standard_normal(dim)).tolist()) for k in range(n)]


def test_clusters_are_those_of_the_contract(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(260, 64)
    rows += [(900, None), (901, [0.0] * 63), (902, [nan] + [0.0] * 63), (903, [inf] * 64), (904, [None] * 64), (905, []), (906, [0.0] * 64), (907, [-1e-9] * 64), (None, [0.5] * 64), (3, rows[3][1]), (3, rows[3][1]), (4, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("cluster", F.lit(1)).withColumn("id", F.lit("x"))
    got = sorted((tuple(r) for r in clustering.op13_clustering(df).collect()), key=str)
    assert got == plain_clusters(rows, clustering.Params())
    assert clustering.op13_clustering(df.limit(0)).count() == 0
    few = rows[:5]
    assert sorted((tuple(r) for r in clustering.op13_clustering(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()), key=str) == plain_clusters(few, clustering.Params())


def test_equal_vectors_and_empty_clusters(spark):
    rows, p = [(k, [float(k % 2), 1.0]) for k in range(30)], clustering.Params(k=6, rounds=4, dim=2, scale=7)
    found, centres = clustering.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), p)
    want = plain_clusters(rows, p)
    assert sorted((r["id"], r["cluster"], r["distance"]) for r in found.collect()) == sorted(w[:3] for w in want)
    assert len(centres) == 6


def test_bounds_save_distances_and_stay_exact():
    rng = np.random.default_rng(2)
    blobs = rng.integers(-900, 900, (12, 16))
    v = (blobs[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 16))).astype(np.int64)
    centres = v[:12].copy()
    every = lambda c: ((v[:, None, :] - c[None]) ** 2).sum(2)
    d, at, history, saved = every(centres), np.zeros((3000, 12), np.int16), centres[None], 0
    own = d.argmin(1)
    for _ in range(12):
        centres = np.array([v[own == j].sum(0) // max(1, (own == j).sum()) if (own == j).any() else c for j, c in enumerate(centres)])
        history = np.concatenate([history, centres[None]])
        own, evaluated = clustering.settle(v, own, d, at, history)
        assert (own == every(centres).argmin(1)).all()
        assert (d == ((v[:, None, :] - history[at, np.arange(12)]) ** 2).sum(2)).all()
        saved += 3000 * 12 - evaluated
    assert saved > 0.6 * 12 * 3000 * 12


# --- quality


def quality_texts():
    rng = np.random.default_rng(4)
    words = ["river", "stone", "Market", "letter", "evening", "garden", "north", "answer", "music", "story", "the", "of", "and"]
    rows, labels = [], []
    for k in range(240):
        picked = list(rng.choice(words, 40))
        bad = k % 3 == 0
        rows.append((k, " ".join(f"{w} |" for w in picked) if bad and k % 2 else " ".join(f"{w}###" for w in picked) if bad else " ".join(picked) + "."))
        labels.append((k, int(not bad), 0))
    return rows, labels


def test_quality_votes_of_all_labelled_neighbours(spark):
    rows, labels = quality_texts()
    rows += [(500, None), (501, ""), (502, "| | |"), (503, rows[1][1] * 3000), (None, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit(9)).withColumn("quality", F.lit(7)).withColumn("lang", F.lit(None).cast("string"))
    labelled = spark.createDataFrame([*labels, (2, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.op11_quality(docs, labelled)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    for r in got.collect():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 240:
            assert r["predicted"] == labels[r["doc_id"]][1]
    model = quality.fit(docs, labelled.where(~quality.held_out(F.col("doc_id"))))
    known = {r["id"] for r in labelled.where(~quality.held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id")).collect()}
    assert 1 not in known or len(model.points) <= len(known)
    scores = {(r["doc_id"], r["score"]) for r in quality.scored(docs, model).collect()}
    for i, text in rows[::17] + rows[-6:]:
        assert any(j == i and abs(s - plain_score(text or "", model)) < 2e-3 for j, s in scores), i
    assert quality.op11_quality(docs.limit(0), labelled).count() == 0


def plain_score(text, m):
    """The vote in plain Python: terms, weights, projection, cosines one by one."""
    sides = [Counter(), Counter()]
    for token in text.split():
        for side, term in enumerate((token.lower(), quality.shape(token))):
            if term in m.rows:
                sides[side][m.rows[term]] += 1
    point = np.zeros(m.axes.shape[1])
    for side in sides:
        w = {t: math.log1p(n) * m.idf[t] for t, n in side.items()}
        length = math.sqrt(sum(x * x for x in w.values())) or 1.0
        for t, x in w.items():
            point += x / length * m.axes[t].astype(float)
    norm = math.sqrt(float(point @ point))
    if norm <= 1e-12:
        return m.prior
    near = [round(float(point @ q.astype(float)) / norm, 5) for q in m.points]
    least = sorted(near, reverse=True)[min(m.neighbours, len(near)) - 1]
    votes = [(c * w, y) for c, w, y in zip(near, m.weight, m.good, strict=True) if c >= least and c > 0]
    return sum(w * y for w, y in votes) / sum(w for w, _ in votes) if votes else m.prior


def test_quality_without_labels_is_the_prior(spark):
    rows, labels = quality_texts()
    docs = spark.createDataFrame(rows[:20], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.op11_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.op11_quality(docs, one).collect()} == {1}


def test_held_out_quality_on_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    r = quality.op11_quality(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").toPandas()
    assert (r["predicted"] == r["quality"]).mean() > 0.95
