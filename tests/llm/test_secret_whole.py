"""The network of the secret scan comes from all documents, in groups that do not depend on how the rows lie."""

import numpy as np
from pyspark.sql import functions as F

from quarryspark.llm import secrets


def test_documents_outside_of_any_sample_train(spark):
    """Only the 3,000 documents with the smallest hashes were read: base spans in others taught nothing."""
    ids = spark.range(3300).withColumn("h", F.xxhash64("id")).orderBy("h").select("id")
    n = {r["id"]: k for k, r in enumerate(ids.collect())}
    r = np.random.default_rng(2)
    value = lambda: "".join(r.choice(list("0123456789abcdef"), 40))
    docs = spark.createDataFrame([(i, f"some words and token = {value()} here" if at >= 3100 else "some plain words") for i, at in n.items()], "doc_id long, text string")
    net = secrets.fit(docs)
    assert max(net.thresholds.values()) <= 1 and set(net.report) == set(secrets.CONTEXTS)
    assert all(recall >= 0.98 for _, recall, _ in net.report.values())


def test_groups_do_not_depend_on_the_layout(spark, monkeypatch):
    """Several groups, slices and partitions; every example is in one group, and the mean stays the same."""
    monkeypatch.setattr(secrets, "GROUP", 100)
    monkeypatch.setattr(secrets, "ROUND", 400)
    monkeypatch.setattr(secrets, "DRAWN", 120)
    monkeypatch.setattr(secrets, "ROUNDS", 2)
    rows = [(k, f"words {k} password: abc{k * 7919}def99 and more/path-{k} words v1.{k}.2-beta") for k in range(120)] + [(120, None), (121, ""), (None, "token = abcdefgh12345")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = secrets.fit(docs.coalesce(1)), secrets.fit(docs.repartition(5))
    assert a.thresholds == b.thresholds and a.scale == b.scale and all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_counts_by_steps_keep_the_floor():
    """Calibration by counts is that of the scores one by one."""
    r = np.random.default_rng(1)
    step, y = r.integers(-200, 200, 500), r.integers(0, 2, 500).astype(float)
    own, times = np.unique(np.stack([step, y]), axis=1, return_counts=True)
    one, many = secrets.Network.fresh(), secrets.Network.fresh()
    one.calibrate((step + np.where(y == 1, 90, 0)) / 64, y, np.ones(500))
    many.calibrate((own[0] + np.where(own[1] == 1, 90, 0)) / 64, own[1], times.astype(float))
    assert np.allclose(one.scale, many.scale) and one.scale[0] > 0
