"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.frames import written


def _both_ways(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                             F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")
    return edges.select(ends).select("e.u", "e.v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least node it sees."""
    ways = _both_ways(edges)
    least = ways.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
    tied = ways.where("v > u").join(least, F.col("u") == F.col("w"))
    return tied.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy(F.col("b").alias("w")).agg(F.min("a").alias("m"))
    tied = edges.join(least, F.col("b") == F.col("w")).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return tied.unionByName(least.select(F.col("m").alias("a"), F.col("w").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the least node of the component, for every node of ``edges (a < b)``.

    Each round is written to the shared folder, so a lost executor never replays earlier
    rounds, and the number of rounds grows with the logarithm of the longest path. Only a
    count and a checksum of the edges reach the driver.
    """
    edges = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    ways = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return ways.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
