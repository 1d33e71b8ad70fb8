"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Rows ``(node, component)`` for every node of ``links``; the component is its smallest node.

    Alternates two steps until nothing changes: every node joins its larger neighbours to its
    smallest neighbour, then its smaller ones. Each step is a minimum per node and a join, so a
    node with very many neighbours is combined before the shuffle and never gathered.
    Null ends and links of a node with itself are ignored; an empty table gives an empty one.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    edges = links.sparkSession.createDataFrame([], edges.schema).union(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    edges = scratch.table(edges, "links")
    before = _state(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        large = large.where("x != y").distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = (
            large.join(low, "x")
            .select(F.explode(F.array(F.struct("m", F.col("y").alias("v")), F.struct("m", F.col("x").alias("v")))).alias("e"))
            .select(F.col("e.m").alias("u"), F.col("e.v").alias("v"))
            .where("u != v")
            .distinct()
        )
        edges = scratch.table(small, "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    leaves = edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return leaves.union(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
