"""A training-data pipeline of five stages over the documents table.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and all but the last return
the columns of documents: the quality classifier drops what it rejects, near-dedup keeps the smallest doc_id of each
group (five-word shingles, similarity 0.8 or more), suffix-array dedup cuts out later copies of 200 bytes or more,
decontamination drops documents that hold benchmark passages, and packing gives the pieces of token sequences.

Defined cases: null and empty texts are scored as empty ones, are nobody's duplicates, lose nothing, hold no benchmark
words and are packed as their end id alone; rows of equal id are told apart, and of equal ones with words one stays; null
ids come after all others; empty tables give no rows; columns beyond those of documents, whatever their names, are kept by
all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stormspan.llm import decontam, neardup, packing, quality, suffix
from stormspan.llm.common import discard, materialize
from stormspan.llm.queries import fold, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), learn=fold(3) != 1)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_copies(docs, length_col="n_chars")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Classifier, signatures, suffix order and packing have no SQL form; tests/llm/test_pipeline.py holds what each stage keeps
#: against brute force (the classifier's stage against its operator's scores).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            if k:
                discard(before)
    return docs
