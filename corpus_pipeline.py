"""Corpus preparation: documents to a clean, mixed and sharded training set.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docledger.llm.common import private, public, table
from docledger.llm.decontaminate import find_contamination
from docledger.llm.mixing import repeat_mixed
from docledger.llm.quality_rules import apply_rules
from docledger.llm.sharding import assign_shards
from docledger.llm.simhash import drop_near_duplicates
from docledger.session import shared_directory


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or a rule go."""
    return public(apply_rules(private(docs), text="_own_text").where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest doc_id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages for at least one word in twenty go."""
    judged = find_contamination(private(docs), table(spark, sf_dir, "benchmark"), text="_own_text")
    return public(judged.where(~judged["contaminated"]), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents are left out, kept or repeated."""
    return repeat_mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, and its shard if there were one more."""
    return assign_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The fingerprints hash shingles with XXH64, which the checking SQL dialect does not offer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what they return lies in the folder all executors share."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_directory(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES[:-1], 1):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
