"""The corpus pipeline: documents in, cleaned, mixed and sharded documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.

Defined cases, for every stage: an empty table gives an empty table; null and
empty texts are not toxic unless the label's share alone says so, are copies of
each other (one stays), hold no benchmark item, have no tokens and are drawn by
their rate, and are sharded like others; rows that repeat are one document from
near_dedup on, which mix may draw again; null ids are ids of their own; columns
may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontam, mixing, near_dup, sharding
from lorekeep.llm import toxicity as _toxicity
from lorekeep.session import saved, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at its threshold or more go; all columns stay."""
    labels = table(spark, sf_dir, "labels")
    return _toxicity.without_toxic(docs, _toxicity.fit(docs, _toxicity.training_rows(labels, held_out=False)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id; all columns stay."""
    return near_dup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; all columns stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says (a fraction by a hash), at most mixing.MOST times; all columns stay."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), MIX, "good")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, and size, text_crc32, shard and slot: counts of the shards differ by at most one."""
    return sharding.with_shards(docs)


#: Target shares of the tokens after toxic documents have gone.
MIX = {"good": 0.9, "low": 0.1}

STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Trained models and iterative stages: not expressible in SQL; tests/llm holds run() and its stages against invariants.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
