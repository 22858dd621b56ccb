"""A corpus pipeline of five stages, each an operator of tessera.llm on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns the rows of documents that stay, with all their columns; the last
returns a row per document from the token files that it wrote. Document ids are those of the input; rows that repeat an
id and a text become one in the second stage, and the fourth repeats rows on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard_join, mixing, quality, token_files
from tessera.llm.io import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the decision list from the labelled documents and drops what it or the base rule rejects."""
    return quality.kept_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by five words and 0.8, the one with the smallest id stays."""
    return jaccard_join.lead_documents(docs, size=5, limit=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what is read back from them, a row per document."""
    return token_files.encode_and_read(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The first stage is learned and the fourth is random, so no SQL gives the same rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
