"""Connected components by alternating star contraction; links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm._shared import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or itself and the smaller ones) are linked to the least of all. Only minima are joined back, from a table, so a hub's rows can be split or need not move."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "links-least")
    pairs = both.join(least, "a")
    if large:
        out = pairs.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).collect()[0]
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for all nodes of the links a, b (long) but the least ones of their components. Links with a null and links of a node with itself say nothing; repeated ones count once; without links the result is empty."""
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = staged(_stars(_stars(edges, True), False), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
