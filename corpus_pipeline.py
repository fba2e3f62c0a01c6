"""Corpus pipeline over ``documents``: toxic documents, near-duplicates and benchmark leaks go,
the rest is mixed to source weights and written as token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all rows
that its predecessor kept, and returns a DataFrame. All but the last return the columns of
``documents``; the mix repeats a document as often as it takes it. ``run`` writes each stage's
result as Parquet into the shared checkpoint folder and reads it again for the next.

SQL can't express these stages (trained model, sketches, alignment, tokenizer), so there is no
``ORACLE_SQL``; the tests compare the pipeline with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiforge.llm import mixing, omh, tiling, token_files, toxicity
from kpiforge.llm.common import staged, table
from kpiforge.llm.queries import tokenizer_path

ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't judge toxic."""
    return toxicity.clean_documents(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return omh.one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return tiling.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix of the sources, each document as often as the mix takes it."""
    return mixing.replayed(mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: per document its place, length and checksum."""
    return token_files.encode_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("source_mix", mixed_sources),
    ("token_files", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
