"""The whole conversation, turn by turn."""

from __spark_entry__ import oracle_sql, queries
from quarryspark.operators import history


def test_every_turn_with_its_whole_text(spark):
    long = "words of a long message " * 50
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "!"), (1, 2, "user", None), (2, 0, "user", ""), (None, 0, "user", "no key")]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    n = {1: 3, 2: 1, None: 1}
    assert sorted(map(repr, map(tuple, history.messages(t).collect()))) == sorted(repr((c, k, r, n[c], x)) for c, k, r, x in rows)
    assert sorted((repr(r["conv_id"]), r["n_turns"], r["roles"], r["opening"]) for r in history.details(t).collect()) == [("1", 3, "user>assistant>user", long[:40]), ("2", 1, "user", ""), ("None", 1, "user", "no key")]
    assert "conversation_messages" in queries() and "conversation_messages" in oracle_sql()
