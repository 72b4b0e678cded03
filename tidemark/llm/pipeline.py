"""A corpus pipeline: five stages over documents, each with one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard, mixing, sharding, toxicity
from ._common import documents, stage


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the model is fitted on the labelled ones among ``docs``."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, at five words and a similarity of 0.8."""
    return jaccard.one_of_each(docs, n=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents stay, go or repeat, by the words that the mix takes of them."""
    return mixing.copies(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, checksum, shard and slot, stored in this order: what can be written as the mixed corpus."""
    return sharding.place(docs, keep=[c for c in docs.columns if c not in ("doc_id", "size", "text_crc32", "shard", "slot")])


STAGES = [
    ("toxicity", toxic_documents),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", source_weights),
    ("sharding", shards),
]

#: Scores, components and blocks taken are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
