"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm import decontaminate, jaccard, mixing, sharding, toxicity
from quarrykit.llm.common import settle


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the scores are learned from four fifths of the labels.

    Null and empty texts stay, repeated rows stay or go together, an empty table
    gives an empty one, and columns of any name are kept; so in every stage.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out(F.col("doc_id")))
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the least doc_id, with all rows that repeat it; rows of a null doc_id stay, as do null and empty texts."""
    return jaccard.distinct(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; short matches are cut out. Each row is judged by itself; without words nothing is hit."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of four fifths of the tokens at the target weights; cells that run out are kept whole. Rows of one doc_id share a draw; texts without tokens are drawn like their cell."""
    return mixing.sample(docs, budget_share=0.8)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document left; a null text counts as empty, equal texts share a shard, repeated rows each take a slot."""
    return sharding.shard(docs, shards=8)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Learned scores, MinHash candidates and raked sampling have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
