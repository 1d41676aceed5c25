"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, token output.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns
a DataFrame, all but the last with the columns of documents. `run` writes each stage's result as Parquet in the shared
folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import decontaminate, langid, mixing, neardup, shared, tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not recognised."""
    return langid.keep_known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return neardup.keep_one(docs)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents to the sources' target weights."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token ids and returns what the files say of each document."""
    return tokens.report(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", deduplicate),
    ("benchmark decontamination", clean_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", token_ids),
]

#: SQL can express neither the models nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared.scratch(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
