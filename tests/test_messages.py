"""Chat messages on literals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quarryspark.functions import messages as ms
from quarryspark.plans import message_queries


@pytest.mark.parametrize(
    ("text", "point", "question", "price", "informational"),
    [
        ("Hi, hello! what is the warranty", "what is the warranty", "what is the warranty", False, True),
        ("hey please tell me more about the battery first", "tell me more about the battery first", "What is the battery?", False, True),
        ("ok so how much", "how much", "how much", True, True),
        ("I want to know about returns?", "I want to know about returns?", "What is returns?", False, True),
        ("thanks a lot", "thanks a lot", "thanks a lot", False, False),
        ("?!", "", "?!", False, False),
        (None, "", "", False, False),
    ],
)
def test_messages(spark, text, point, question, price, informational):
    t = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(ms.without_fillers(t), ms.canonical_question(t), ms.asks_for_price(t), ms.is_informational(t)).first()
    assert tuple(row) == (point, question, price, informational)


ODD = [
    "Doíó osja", "Do osja", "éprice", "price é", "pricé", "the price", "prıce", "iſ it", "IS it", "Iś it", "how ", "tell me about a\rb", "tell me about a ", "tell me about\x0bthe a", "\x0bhi\x0b what is x", "hi \u0085", "x  ",
    "HI, Hello! WHAT IS X", "Know more", "benefits_", "who  is", "why?", "why2", "the warranty.", "ok", "hi hi hi", None, "", "tell me about a\nb", "hello hola ſo", "what's", "x²mrp mrp²",
]


def test_intents_of_odd_messages_are_those_of_the_sql(spark, tmp_path):
    """Words end at letters of any script, white space and line ends are the same, and (?i) is of A-Z alone."""
    rows = [(k, k, "user", t) for k, t in enumerate(ODD)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own = message_queries.message_intents(spark, str(tmp_path)).orderBy("conv_id").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.execute(message_queries.ORACLE_SQL["message_intents"] + " ORDER BY conv_id").fetchall()
    assert [tuple(r) for r in own] == sql
    informational = {ODD[r["conv_id"]] for r in own if r["informational"]}
    assert "Do osja" in informational and "Doíó osja" not in informational and "éprice" not in informational
