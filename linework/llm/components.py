"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import join_hot
from linework.sources.scratch import fresh_path, put, remove


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_hot(down, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(u, v): component is the smallest node reachable.

    Large-star and small-star rounds until the edges no longer change.  Each round's table is
    written to the shared folder and the one before it removed, so a lost executor costs no more
    than the round at hand.  A centre of many edges doesn't travel by its key (join_hot).
    Loops and repeated edges are ignored, null ends dropped; a node without edges doesn't appear; no
    edges give an empty table.
    """
    spark, (a, b) = edges.sparkSession, edges.columns[:2]
    path = fresh_path(spark, "edges")
    edges = put(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), path)
    before = _state(edges)
    while before[0]:
        old, path = path, fresh_path(spark, "edges")
        edges = put(_small_star(_large_star(edges, before[0]), 2 * before[0]), path)
        remove(spark, old)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
