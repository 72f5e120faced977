"""The registered queries of this subpackage, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import byte_bpe, exact_dedup, jaccard_join, language_id, ngram_lm, packing, quality, secrets, sharding, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": jaccard_join.query,
    "op2_language_id": language_id.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_sharding": sharding.query,
    "op5_best_fit_packing": packing.query,
    "op6_quality_rules": quality.query,
    "op7_token_counts": token_counts.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_secret_scans": secrets.query,
    "op10_lm_scoring": ngram_lm.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_sharding": sharding.ORACLE_SQL,
}
