"""Corpus preparation from raw documents to packed sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes and rereads as
the next stage's documents. All but the last return the columns of `documents`. Only the secret
scan changes texts: it masks secrets in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelgrove.llm.common import prepare, stored, table
from labelgrove.llm.decontaminate import without_contaminated
from labelgrove.llm.language import with_language
from labelgrove.llm.near_dedup import without_near_duplicate_rows
from labelgrove.llm.pack import pack
from labelgrove.llm.secrets import redacted


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, for which no language can be told, go."""
    return with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar texts stays."""
    return without_near_duplicate_rows(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are masked."""
    return redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 4096."""
    return pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Language profiles, the forest and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
