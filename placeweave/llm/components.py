"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps: each replaces edges by edges to
the smallest neighbour, until every component is one star around its smallest
node.  A step is a partial-aggregated minimum per node and a join; the edges
of each round are written to the shared folder.  Only two numbers per round
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = (down.join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
             .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` with ``u <> v`` → ``(u, v)``: every node that is not
    the smallest of its component with that smallest node."""
    edges = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges
