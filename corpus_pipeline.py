"""The corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns the encoded corpus. Null and empty texts have no letter and go in the first stage; rows that
repeat a text leave one in the second, rows that repeat an id and differ are worked on each; an empty table passes through
as empty; further columns are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers as public
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryspark.llm import byte_bpe, exact_dedup, language_id, mixing, near_dup
from quarryspark.llm.shared import table, written

#: Documents whose language is less sure than this go, as do those without letters.
LEAST_SURE = 0.5
RANKS = "byte_bpe_multi_50k.tiktoken"


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in no language that the labelled rows have. `lang` becomes the predicted
    language."""
    found = language_id.predict(docs, language_id.learned_from(docs), keep=tuple(docs.columns))
    sure = found.where((F.col("lang_pred") != language_id.NONE) & (F.col("score") >= LEAST_SURE))
    return sure.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("kept").getField(c).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the row with the smallest id stays."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; of each group the smallest id stays. Texts without words stay."""
    return near_dup.kept_documents(docs, near_dup.Params(words=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, no document twice. Null sources and languages are leaves of their own."""
    levels = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mixture(docs, mixing.Params(mixing.TABLE_WEIGHTS, share=(4, 5), epochs=1), levels)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids as little-endian unsigned 32-bit integers, their number and hash, and the hash of
    the bytes that they decode to."""
    path = public.path(RANKS)
    tokens = byte_bpe.encoded(docs, path, public.PATTERN, keep=("doc_id", "lang", "source"), spaces_begin=True)
    back = byte_bpe.decoded(tokens.withColumn("kept_ids", F.col("ids")), path, keep=("doc_id", "lang", "source", "kept_ids"))
    return back.select("doc_id", "lang", "source", F.col("kept_ids").alias("ids"), "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: The language model is not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
