"""The registered queries of this package, over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, clustering, collocations, embedding_dedup, exact_dedup, language_id, licenses, mixing, near_dup, quality, secrets, token_output, toxicity
from .shared import table


def _on(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, name) for name in names])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": _on(exact_dedup.op1_exact_dedup, "documents"),
    "op2_byte_bpe": _on(byte_bpe.op2_byte_bpe, "documents"),
    "op3_secret_scan": _on(secrets.op3_secret_scan, "documents"),
    "op4_token_output": _on(token_output.op4_token_output, "documents"),
    "op5_license_scan": _on(licenses.op5_license_scan, "documents"),
    "op6_toxicity": _on(toxicity.op6_toxicity, "documents", "labels"),
    "op7_language_id": _on(language_id.op7_language_id, "documents"),
    "op8_minhash": _on(near_dup.op8_minhash, "documents"),
    "op9_embedding_dedup": _on(embedding_dedup.op9_embedding_dedup, "embeddings"),
    "op10_mixing": _on(mixing.op10_mixing, "documents"),
    "op11_quality": _on(quality.op11_quality, "documents", "labels"),
    "op12_collocations": _on(collocations.op12_collocations, "documents"),
    "op13_clustering": _on(clustering.op13_clustering, "embeddings"),
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE, "op5_license_scan": licenses.ORACLE, "op8_minhash": near_dup.ORACLE, "op9_embedding_dedup": embedding_dedup.ORACLE, "op10_mixing": mixing.ORACLE,
    "op12_collocations": collocations.ORACLE, "op13_clustering": clustering.ORACLE,
}
