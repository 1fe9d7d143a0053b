"""Cleaning and mixing of the documents table, stage by stage; each stage's rows are written and read again by the next.

Defined cases, for every stage: all columns of documents stay, extra ones and clashing names included (sharding replaces
columns named shard and slot); an empty table gives an empty one. Null and empty texts aren't toxic and hold no passage; they
are copies of each other, of which one stays; they cost the mixture nothing and stay where their leaf gets tokens. Null ids
are ids like others but come last where the smallest id decides. Repeated rows are copies to near_dedup; to mixing and
sharding they are rows like others. Null domain, lang and source are leaves of their own. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import decontaminate, mixing, sharding, simhash, toxicity
from strataloom.llm.common import drop_made, made_here, saved, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that one seeded epoch of the target mixture takes."""
    return mixing.select(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.assign(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SimHash, learned lexicons and Hamming blocks have no counterpart in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), set(made_here())
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        # what the stage wrote in between, and its input, are no longer needed: only its rows, the newest folder, are
        drop_made(spark, [at for at in made_here()[:-1] if at not in before])
    return docs
