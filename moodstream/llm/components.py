"""Connected components by alternating stars, kept in the shared folder from round to round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodstream.llm.shared import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), the component being its smallest node.

    Each round ties larger neighbours to the smallest one (large star), then smaller ones (small star); the number of
    rounds grows with the logarithm of the longest path. A hub's edges are never gathered: its smallest neighbour is
    an aggregate, and the join that brings it back may be split. Loops and repeated edges change nothing; nodes
    without a link to another node are not returned. Nulls are no nodes.
    """
    links = edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = stored(links.distinct(), "links")
    before = None
    while (state := _state(links)) != before:
        before = state
        both = links.union(links.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stored(large, "large-star")
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = stored(small.union(lowest).distinct(), "links")
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
