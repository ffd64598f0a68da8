"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.

Null and empty texts fail the base rules and go in the first stage; very long texts go through whole; of
repeated rows one stays; null doc_ids and other columns, whatever they are called, are passed on; without
labels the model keeps what passes the base rules; an empty benchmark removes nothing; empty documents give
no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import decontaminate, ngram_join, packing, quality, secret_scan
from maskwright.llm.common import Stages, table
from maskwright.llm.tokens import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the quality model; the others go."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least doc_id (of equal rows, one)."""
    return ngram_join.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    return secret_scan.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of token ids."""
    return packing.digest(packing.pack(docs, tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secrets),
    ("packing", packed),
]

#: The rows depend on a trained model, edit distances and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what one has read is deleted."""
    docs, last = table(spark, sf_dir, "documents"), []
    stages = Stages(spark, "pipeline")
    for _name, stage in STAGES[:-1]:
        docs = stages.write(stage(spark, docs, sf_dir))
        stages.drop(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
