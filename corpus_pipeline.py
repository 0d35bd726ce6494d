"""From raw documents to packed training sequences.

Stages, each written as Parquet and read again before the next: documents whose repetition rules fail go,
toxic documents go, one document of each group of near-duplicates stays, the rest is packed. All but the
last return the columns of ``documents``. The dedup stage looks at texts: different texts under one id, or
without an id, stay each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from changeflow.llm.compression_toxicity import keep_ordinary, learn_toxicity
from changeflow.llm.minhash import keep_one_of_each
from changeflow.llm.packing import pack
from changeflow.llm.repetition import keep_unrepetitive
from changeflow.llm.queries import prepared
from changeflow.session import work_dir

VOCABULARY = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on repetition."""
    prepared(spark)
    return keep_unrepetitive(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model learned from the labelled rows of ``documents``."""
    prepared(spark)
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return keep_ordinary(docs, learn_toxicity(documents, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of linked texts."""
    prepared(spark)
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    prepared(spark)
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: The toxicity stage is a learned model, which SQL can't express; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
