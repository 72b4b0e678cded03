"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def components(links: DataFrame, label: str = "component") -> DataFrame:
    """(node, ``label``) for every node of ``links`` (a, b: longs): the smallest
    node that it reaches. A round costs two shuffles of what links remain; a
    node with very many links is a minimum by partial aggregation, then a join
    that adaptive execution splits. Rounds end when no link changes."""
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = stage(small.select("e.*").where("a != b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias(label)).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias(label)).unionByName(tops)
