"""From raw documents to token files: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skydrift.llm import decontaminate, mixing, near_dedup, quality, token_codes
from skydrift.llm.common import Workspace

#: Weights of domains, languages and sources; all tokens are handed out, no document more than four times.
RECIPE = mixing.Recipe()


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a window of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Epochs and prefixes of the sources, to the recipe's weights."""
    return mixing.select(spark, docs, RECIPE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they say of each document."""
    return token_codes.encode(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [("quality", good_quality), ("near_dedup", one_of_each_class), ("decontamination", without_benchmark), ("mixing", mixed), ("token_codes", tokens)]

#: A classifier and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
