"""License notices that run over line ends, against brute force."""

import textwrap

import numpy as np

from quarryspark.llm import licenses

SETS = [set(licenses.words_of(t.encode())) for _, t in licenses.TEMPLATES]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_wrapped_notices_are_found(spark):
    rows = []
    for k, (_, notice) in enumerate(licenses.TEMPLATES):
        for width in (24, 40, 68):
            for mark in ("", " * ", "# "):
                text = textwrap.fill(f"Some words stand here. {notice}, and others follow it.", width, initial_indent=mark, subsequent_indent=mark, break_long_words=False)
                rows.append((len(rows), k, f"first line\n{text}\nlast line"))
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, k int, text string").select("doc_id", "text")))
    for i, k, text in rows:
        assert (k, 1.0) in [(b["template"], b["containment"]) for b in got[i]["blocks"]], text
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    row = by_id(licenses.op5_license_scan(spark.createDataFrame([(1, bsd), (2, bsd.replace("\n", "\r\n\r\n"))], "doc_id long, text string")))
    assert [(row[i]["n_base"], row[i]["labels"], row[i]["score"]) for i in (1, 2)] == [(0, "bsd", 1.0)] * 2


def test_windows_are_exact():
    """No window of the reach that brute force finds is lost, none is added, and each names the words it holds."""
    r = np.random.default_rng(8)
    vocab = sorted(set().union(*SETS))
    index = licenses.Templates(licenses.TEMPLATES, {w: int(r.integers(1, 50)) for w in vocab}, 0.8)
    met = 0
    for _ in range(1500):
        words = []
        for _ in range(int(r.integers(1, 4))):
            own = licenses.words_of(licenses.TEMPLATES[int(r.integers(len(SETS)))][1].encode())
            words += [w for w in own if r.random() < 0.92 for w in ([w, b"other"] if r.random() < 0.1 else [w])]
            words += [vocab[int(i)] if r.random() < 0.5 else b"other" for i in r.integers(0, len(vocab), int(r.integers(0, 12)))]
        got = index.windows(words)
        for k, s in enumerate(SETS):
            most = max((len(s & set(words[i : i + index.reach[k]])) for i in range(len(words))), default=0)
            mine = [x for x in got if x[0] == k]
            assert bool(mine) == (most >= index.need[k])
            if mine:
                met += 1
                assert max(c for *_, c, _ in mine) == most / len(s) and all(x[4] for x in mine)
                assert all(b - a <= index.reach[k] and len(s & set(words[a:b])) / len(s) == c for _, a, b, c, _ in mine)
                assert all(x[2] <= y[1] for x, y in zip(mine, mine[1:]))
    assert met > 1000
    twice = licenses.words_of(b"Released under the MIT License.\nReleased under the MIT License.")
    assert [(a, b) for k, a, b, *_ in index.windows(twice) if k == 0] == [(0, 5), (5, 10)]


def test_names_and_distance_decide(spark):
    far = " ".join(["released early"] + ["word"] * 50 + ["under"] + ["word"] * 50 + ["the"] + ["word"] * 50 + ["license"] + ["word"] * 50 + ["mit"])
    texts = {
        "Released under the Apache License": "apache", "Released under the GNU General Public License": "gpl", far: "", "Released under MIT License": "mit", "Released under this, the MIT (X11) License": "mit",
        "Licensed under CC BY-SA 4.0": "", "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0", "This work is licensed under the GNU General Public License, version 2": "gpl", "Licensed under the Mozilla License, Version 2.0": "",
        "under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "gpl,lgpl",
    }
    got = by_id(licenses.op5_license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert {t: got[k]["labels"] for k, t in enumerate(texts)} == texts
    assert got[2]["score"] == 0
    own = (("foo", "Released under the Foo License"),)
    rows = [(0, "released under the bar license"), (1, "released\nunder the Foo\nlicense")]
    found = sorted(by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), own)).items())
    assert [[(b["containment"], b["named"]) for b in r["blocks"]] for _, r in found] == [[(0.8, False)], [(1.0, True)]]
    unversioned = spark.createDataFrame([(0, "This work is licensed under the General Public License, version 3")], "doc_id long, text string")
    assert [(b["label"], b["named"]) for b in licenses.scan(unversioned).first()["blocks"]] == [("gpl-3.0", False)]
    assert licenses.op5_license_scan(unversioned).first()["templates"] == "5"


def test_windows_with_names_are_exact():
    r = np.random.default_rng(9)
    vocab = sorted(set().union(*SETS))
    index = licenses.Templates(licenses.TEMPLATES, {w: int(r.integers(1, 50)) for w in vocab}, 0.8, licenses.NAMES)
    must = [{w for w in s if w in licenses.NAMES or w.isdigit()} for s in SETS]
    met = lost = 0
    for _ in range(1500):
        own = licenses.words_of(licenses.TEMPLATES[int(r.integers(len(SETS)))][1].encode())
        words = [w for w in own if r.random() < 0.9] + [vocab[int(i)] if r.random() < 0.5 else b"other" for i in r.integers(0, len(vocab), 12)]
        every = index.windows(words)
        got = {k: c for k, _, _, c, named in sorted(every, key=lambda x: x[3]) if named}
        for k, s in enumerate(SETS):
            held = [s & set(words[i : i + index.reach[k]]) for i in range(len(words))]
            most = max((len(h) for h in held if must[k] <= h), default=0)
            assert (k in got) == (most >= index.need[k]) and (k not in got or got[k] == most / len(s))
            assert (max(map(len, held)) >= index.need[k]) == any(x[0] == k for x in every)
            met, lost = met + (k in got), lost + (k not in got and max(map(len, held)) >= index.need[k])
    assert met > 500 and lost > 20


def test_three_hundred_templates():
    """Windows of 300 templates over one vocabulary, each within the reach of a prefix of its own, against brute force."""
    r = np.random.default_rng(12)
    vocab = [f"w{k}" for k in range(500)]
    templates = tuple((f"t{k}", " ".join(vocab[int(i)] for i in r.zipf(1.3, int(r.integers(5, 25))) % 500)) for k in range(300))
    sets = [set(licenses.words_of(t.encode())) for _, t in templates]
    index = licenses.Templates(templates, {w.encode(): 500 - k for k, w in enumerate(vocab)}, 0.8)
    met = 0
    for _ in range(12):
        words = []
        for _ in range(6):
            own = licenses.words_of(templates[int(r.integers(300))][1].encode())
            words += [w for w in own if r.random() < 0.95] + [vocab[int(i)].encode() for i in r.integers(0, 500, 10)]
        got = {k for k, *_ in index.windows(words)}
        want = {k for k, s in enumerate(sets) if any(len(s & set(words[i : i + index.reach[k]])) >= index.need[k] for i in range(len(words)))}
        assert got == want
        met += len(want)
    assert met >= 60
