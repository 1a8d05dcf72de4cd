"""Corpus preparation over ``documents``: toxic texts out, one of each near-duplicate group, benchmark passages out,
sources mixed, shards assigned.

A stage gets what its predecessor wrote and returns a frame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daymart.llm import decontamination, mixing, ngram_join, sharding, toxicity
from daymart.llm.common import chunk_batches
from daymart.session import StageArea


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.7 or more; learned from the labelled rows that are not held out."""
    chunk_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    chunk_batches(spark)
    return ngram_join.one_per_group(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words inside windows of ten words that stand in a benchmark item too."""
    chunk_batches(spark)
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by weights 3, 1, 2 over the sources takes them, twice at most."""
    return mixing.repeat(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns with the shard (of eight) and the slot in it."""
    return sharding.sharded(docs, 8)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_per_group),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: learned scores are beyond SQL; the tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    area = StageArea(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = area.save(stage(spark, docs, sf_dir), name)  # cuts the lineage; a later stage reads it several times
    return STAGES[-1][1](spark, docs, sf_dir)
