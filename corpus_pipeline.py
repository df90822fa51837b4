"""From raw documents to packed training sequences: five stages over the tables of one folder.

Each stage takes what the one before it kept, as rows of ``documents``; the last returns pieces of
sequences. SQL cannot express the classifier or the tokenizer, so there is no SQL of the whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lineamix.llm import decontamination, exact_dedup, near_dedup, packing, quality
from lineamix.llm.common import table, written
from lineamix.llm.tokens import definition_of
from lineamix.session import small_batches

TOKENIZER = "word_bpe_49k.json"
DOCUMENT_END = 1
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at similarity 0.8: one document of each group stays."""
    small_batches(spark)
    return near_dedup.deduplicate(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with a passage of the benchmark go."""
    small_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all documents in sequences of 2048 ids."""
    small_batches(spark)
    return packing.pack(docs, definition_of(public_tokenizers.path(TOKENIZER)), DOCUMENT_END)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
