"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept. All but
the last return the columns of ``documents``: toxic documents go; of each near-duplicate group one
stays; documents that hold a benchmark window go; secrets are replaced in the text; what is left is
tokenized and packed into sequences.

Defined cases: null texts pass all stages and are packed as empty documents; the near-duplicate and benchmark
decisions are taken for each pair of id (or no id) and text, and of equal rows in a group one stays; columns beside the known ones pass through to the packing; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import decontaminate, neardup, packing, secrets, toxicity
from colloquy.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_row_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark leaks", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Tokenization, learned scores and minhash groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
