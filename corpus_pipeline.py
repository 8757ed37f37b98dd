"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resolvescope.llm import decontamination, simhash, toxicity
from resolvescope.llm.common import Scratch, free_names, read_table, row_key
from resolvescope.llm.queries import documents_mixture


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from ``labels`` does not hold toxic."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 2 or fewer differing bits, over three-word shingles."""
    return simhash.one_of_each(docs, keep_nameless=False)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with ``benchmark``; rows are named by id and text, as ids may be missing or repeated."""
    (row,) = free_names(docs, "row")
    return decontamination.without_overlaps(docs.withColumn(row, row_key()), read_table(spark, sf_dir, "benchmark"), row).drop(row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by target weights: a row per copy of a document."""
    return documents_mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("mixture", mix_sources),
]

ORACLE_SQL = None
"""No SQL has the learned scores and the XXH64 shingles; the tests compare with brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
