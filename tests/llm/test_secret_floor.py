"""The learned part of the secret scan: planted secrets that no base pattern knows, and the floor of recall."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quarryspark.llm import secrets

LOW = "abcdefghijklmnopqrstuvwxyz"
ALL = LOW + LOW.upper() + "0123456789"


def corpus(n=400):
    """Documents, and for each the kind of its last run: planted secrets without keyword, or ordinary runs."""
    r = np.random.default_rng(11)
    pick = lambda letters, n: "".join(letters[int(i)] for i in r.integers(0, len(letters), n))
    words = [pick(LOW, int(r.integers(2, 9))) for _ in range(300)]
    some = lambda n: " ".join(words[int(i)] for i in r.integers(0, 300, n))
    make = {
        "ghp": lambda: "ghp_" + pick(ALL, 35) + "7", "jwt": lambda: ".".join(["eyJhbGciOiJIUzI1NiJ9", "eyJ" + pick(ALL, 40) + "3", pick(ALL, 43)]), "base64": lambda: pick(ALL + "+/", 42) + "4A==", "upper": lambda: pick("0123456789ABCDEF", 62) + "A1",
        "mail": lambda: f"{some(1)}.{some(1)}.{pick('123456789', 2)}@mail{pick('123', 1)}.example.com", "url": lambda: f"https://{some(1)}.example.org/{some(1)}/{some(1)}-{pick('123456789', 3)}", "version": lambda: f"{some(1)}library-{pick('123456789', 1)}.{pick('123456789', 2)}.4",
    }
    rows, kinds = [], []
    for k in range(n):
        base = f' token = "{pick("0123456789abcdef", 40)}" ' if k % 5 == 0 else f" password: {pick(ALL, 14)}9 " if k % 5 == 1 else " "
        kinds.append(list(make)[k % 7])
        rows.append((k, f"{some(30)}{base}{some(900)} {make[kinds[-1]]()} {some(20)}"))
    return rows, kinds


def test_planted_secrets_without_keyword_and_the_floor(spark):
    rows, kinds = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    net = secrets.fit(docs)
    found = {r["doc_id"]: len(r["learned"]) > 0 for r in secrets.scan(docs, net).collect()}
    for kind in ("ghp", "jwt", "base64", "upper"):
        own = [found[k] for k, x in enumerate(kinds) if x == kind]
        assert sum(own) >= 0.95 * len(own), kind
    for kind in ("mail", "url", "version"):
        own = [found[k] for k, x in enumerate(kinds) if x == kind]
        assert sum(own) <= 0.1 * len(own), kind
    assert set(net.report) == set(secrets.CONTEXTS)
    assert all(n > 100 and recall >= 0.98 and 0 < precision <= 1 for n, recall, precision in net.report.values())


def test_ordinary_runs():
    yes = ["https://some.example.org/path/to-page-12", "library-1.20.3-beta", "2024-01-02T10", "section_12_overview", "jo.smith.55@mail4.example.com"]
    no = ["ghp_16C7e42F292c6912E7710c838347Ae178B4a", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0.TJVA95OrM7E2cBab30RM", "0FA3B5C7D9E1F2A4B6C8", "q83vEjRWeJCrze8SNFZ4kA=="]
    spans = lambda t: secrets.findings(t)[1]
    assert all(spans(t) and all(secrets.ordinary(t, a, b) for a, b in spans(t)) for t in yes)
    assert all(len(spans(t)) == 1 and not secrets.ordinary(t, *spans(t)[0]) for t in no)


def test_every_character_of_a_long_candidate_is_seen():
    """A secret in the middle of a long run of words and numbers is in a window of its own."""
    r = np.random.default_rng(1)
    for n in (12, 43, 44, 45, 90, 200, 1000):
        text = "some words " + "".join(r.choice(list("abc1"), n)) + " more words"
        start, windows = 11, secrets.encoded_windows("x" * 11 + "b" * n + " end", 11, 11 + n)
        assert len(windows) == 1 + max(0, -(-(n - 44) // 44)) and text[start : start + n]
        marked = [int((w >= 128).sum()) for w in windows]
        assert marked[0] >= min(n, 44) and all(m > 36 for m in marked[1:])
    plain = "/".join(["alpha", "beta12"] * 12)
    at = "go " + plain + "ZZZZZZZZ" + plain + " on"
    seen = np.zeros(len(at), bool)
    for w in secrets.encoded_windows(at, 3, len(at) - 3):
        seen |= (w[24:68] - 128 == ord("Z") - 30).any() * np.array([c == "Z" for c in at])
    assert seen.sum() == 8


def test_spans_gain_a_learned_span_end_to_end(spark):
    rows, kinds = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.op3_secret_scan(docs).collect()}
    assert sum("learned:" in got[k] for k, x in enumerate(kinds) if x == "ghp") >= 0.95 * kinds.count("ghp")
    copies = docs.union(docs).withColumn("base", F.lit("clash")).withColumn("t", F.lit(1)).withColumn("kept", F.lit(2))
    assert sorted((r["doc_id"], r["spans"]) for r in secrets.scan(copies, secrets.Network.fresh()).selectExpr("doc_id", "cast(base as string) spans").collect()) == sorted(2 * [(r["doc_id"], r["s"]) for r in secrets.scan(docs, secrets.Network.fresh()).selectExpr("doc_id", "cast(base as string) s").collect()])


def test_base_columns_against_plain_patterns(spark):
    """The base spans of random texts again, by the contract's patterns alone."""
    r = np.random.default_rng(11)
    bits = ["token", "API_KEY", "apikey", "password", "passwd", "Secret", " = ", ":", "\"", "'", "AKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef", "é", "漢", " ", "\n", "x-y/z", "=", "+.", "short"]
    rows = [(k, "".join(bits[int(i)] for i in r.integers(0, len(bits), int(n)))) for k, n in enumerate(r.integers(0, 30, 400))] + [(400, None), (401, "")]
    assign = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = ("assign", "access", "hex")

    def by_hand(t):
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
        line = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
        return (*[sum(k == j for _, k, _ in spans) for j in range(3)], hashlib.sha256(line.encode()).hexdigest())

    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.op3_secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: by_hand(t or "") for i, t in rows} and sum(x[0] > 0 for x in got.values()) > 20
