"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes: equal states are equal edge sets."""
    x = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum((x % 1_000_003).cast("long")), F.sum(F.shiftright(x, 32))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns a, b of one orderable type).

    root is the smallest node of the component. Every round maps each node's
    neighbours to its smallest one, first for larger neighbours, then for smaller
    ones, which leaves a star per component after about log(n) rounds. Only minima
    are grouped (combined before the shuffle); a hub's edges meet their minimum in a
    plain equi-join, which adaptive execution can split. Rounds end on equal states;
    each is written to the shared folder, so that a lost executor costs one round.
    An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = written(edges, "edges")
    before = _state(edges)
    while before[0]:
        sides = _both_ways(edges)
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, then = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = _state(after)
        drop(spark, path)
        edges, path = after, then
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
