"""A training corpus from ``documents``: five stages, each one operator of ``veloscore.llm``.

Every stage reads what the one before has written and its decisions take effect; all but the last
return the columns of documents.

1. language_id: documents whose language cannot be told (null or without a letter) go.
2. line_dedup: repeated windows of three lines lose their later occurrences; a document that loses
   every line goes.
3. ngram_join: of each component of near duplicates the document with the smallest id stays.
4. decontaminate: documents that are contaminated by the benchmark go.
5. mixing: the words that the mix takes of each document, and its place in training.

Null texts are gone after the first stage; rows with null ids stay documents of their own. Repeated
rows end as one in the third stage. Extra columns are carried along. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veloscore.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from veloscore.session import checkpoint_root


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_first_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: Language identification fits a model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_root(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
