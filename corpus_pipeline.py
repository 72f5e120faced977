"""From raw documents to packed training sequences, in five stages, each reading what the one before has written.

All stages but the last return the columns of `documents`. The last returns one row per packed piece.

Defined cases: rows with a null or empty text fail the base rules and go in the first stage; of rows with equal texts the one
with the largest doc_id stays (a null id is the smallest); rows that repeat a doc_id with different texts are kept or dropped
each by its own text until the near stage, which takes an id's rows as one document; rows with a null doc_id are never dropped
as near copies; extra columns pass through all stages but the last; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import cut, forget
from rivulet.llm.exact_dedup import drop_copies
from rivulet.llm.jaccard_join import drop_near_copies
from rivulet.llm.packing import best_fit_packing
from rivulet.llm.quality import clean_documents
from rivulet.llm.secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes failing lines, and documents that fail the base rules or lose too much."""
    return clean_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies."""
    return drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] in place of secrets."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 2048."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
            forget(*written)  # what the stage has read
            written = [docs]
    return docs


#: Tokenizing, Markov models and line rules are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
