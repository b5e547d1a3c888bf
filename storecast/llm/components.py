"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storecast.llm.common import join_counted, materialize


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Link neighbours of every node to the least of them and the node: the larger neighbours, or all not larger."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    linked = join_counted(both, materialize(least, "least"), ["u"], "v", total)
    if large:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    moved = linked.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges`` (columns a, b, no nulls): component is its least node.

    The steps keep the components and end in stars, after a number of rounds that grows with the
    logarithm of the longest chain. Each round is written to the shared folder. An empty table gives
    no rows; loops and repeated edges are allowed.
    """
    current = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    state, total = None, current.count()
    while True:
        larger = materialize(_star(current, True, total), "edges")
        current = materialize(_star(larger, False, total), "edges")
        found = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).head()
        if tuple(found) == state:
            break
        state, total = tuple(found), found[0]
    return (current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
