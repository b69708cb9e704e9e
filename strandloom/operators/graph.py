"""Patterns of steps through a graph of typed edges, from many starts at once.

A pattern is a row of steps; each follows edges of some predicates, forward or backward, for a fixed or bounded number of hops, to nodes that meet a condition. The frontier
is a table of (start, node) with one path each; a hop is one equality join with the edges, after which all but the least path of a pair go, and within a step pairs
that were reached by fewer hops. So the frontier is bounded by pairs, not by paths, and every pair keeps a shortest path. Each hop is written once.

Edges are subject, predicate, object; those with a null are not followed. Paths are walks: a node can come again. Of equally short paths the least by its texts is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.staging import stage

PATH = "start string, node string, path array<struct<predicate: string, node: string>>"


@dataclass(frozen=True)
class Step:
    """Edges of these predicates (None: of all), backward or not, from `least` to `most` hops. where: a condition on columns of the nodes table, for the node at the end of the step."""

    predicates: tuple[str, ...] | None = None
    backward: bool = False
    least: int = 1
    most: int = 1
    where: Column | None = None


def _shortest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("start", "node").agg(F.min_by("path", F.struct(F.size("path"), F.transform("path", lambda x: F.concat_ws("|", x["predicate"], x["node"])))).alias("path"))


def paths(edges: DataFrame, starts: DataFrame, steps: list[Step], nodes: DataFrame | None = None) -> DataFrame:
    """start, node and path (PATH) of the pairs that the steps join. starts: node; nodes: node and what conditions ask for."""
    for step in steps:
        if not 0 <= step.least <= step.most:
            raise ValueError(f"a step of {step.least} to {step.most} hops")
    edges = edges.where("subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL").select("subject", "predicate", "object")
    first = starts.where("node IS NOT NULL").select(F.col("node").cast("string").alias("node")).distinct()
    frontier = first.select(F.col("node").alias("start"), "node", F.array().cast("array<struct<predicate: string, node: string>>").alias("path"))
    for step in steps:
        frontier = _one(edges, frontier, step, nodes)
    return frontier


def _one(edges: DataFrame, frontier: DataFrame, step: Step, nodes: DataFrame | None) -> DataFrame:
    if step.predicates is not None:
        edges = edges.where(F.col("predicate").isin(list(step.predicates)))
    a, b = ("object", "subject") if step.backward else ("subject", "object")
    links = edges.select(F.col(a).alias("from_"), F.concat(F.lit("^" if step.backward else ""), "predicate").alias("p_"), F.col(b).alias("to_")).distinct()
    new = stage(frontier, "paths")
    reached = new if step.least == 0 else None
    for hop in range(1, step.most + 1):
        joined = new.join(links, new["node"] == links["from_"])
        grown = _shortest(joined.select("start", F.col("to_").alias("node"), F.array_append("path", F.struct(F.col("p_").alias("predicate"), F.col("to_").alias("node"))).alias("path")))
        if reached is not None:
            grown = grown.join(reached.select("start", "node"), ["start", "node"], "left_anti")
        new = stage(grown, "paths")
        if hop >= step.least:
            reached = new if reached is None else reached.unionByName(new)
        if hop < step.most and new.isEmpty():
            break
    out = new.limit(0) if reached is None else reached
    if step.where is not None:
        out = out.join(nodes.where(step.where).select("node").distinct(), "node", "left_semi")
    return out.select("start", "node", "path")


def expand_nearest(found: DataFrame, edges: DataFrame, steps: list[Step], node: str = "id", score: str = "similarity", nodes: DataFrame | None = None) -> DataFrame:
    """Nearest rows of a vector search as starts: node, hops, similarity (of the best start that leads there) and that start. The starts themselves are in with no hops."""
    starts = found.groupBy(F.col(node).cast("string").alias("node")).agg(F.max(score).alias("score"))
    led = paths(edges, starts.select("node"), steps, nodes).select("start", "node", F.size("path").alias("hops"))
    every = led.unionByName(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")))
    scored = every.join(starts.select(F.col("node").alias("start"), "score"), "start")
    best = scored.groupBy("node").agg(F.max_by(F.struct("hops", "score", "start"), F.struct("score", -F.col("hops"), "start")).alias("b"))
    return best.select("node", "b.hops", F.col("b.score").alias("similarity"), "b.start")
