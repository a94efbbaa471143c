"""Five stages that turn raw documents into token files, each an operator of postvet.llm.

Toxic documents go, one document of each near-duplicate component stays, documents that
hold a benchmark passage go, sources are mixed to target weights, and what is left is
encoded. Every stage reads what the one before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postvet.llm import decontamination, mixing, near_dedup, token_files, toxicity
from postvet.llm.common import ready, table
from postvet.llm.queries import END_ID, tokenizer_path
from postvet.session import new_shared_path, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents whose probability of being toxic is under one half."""
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    ready(spark)
    return near_dedup.near_dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep documents without a benchmark passage."""
    return decontamination.drop_leaks(docs, table(spark, folder, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document as often as the mix takes it; repeats are rows of their own."""
    ready(spark)
    return mixing.mixed_rows(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids in the shared folder; the digest of each row as read back from there."""
    ready(spark)
    return token_files.token_files(
        docs, new_shared_path(spark, "tokens"), tokenizer_path("word_bpe_49k.json"), END_ID
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

# The first stage is a trained model, so no SQL gives the rows.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in turn over `documents`, each one's rows written and read again."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)
