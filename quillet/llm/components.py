"""Connected components by alternating star contraction, on DataFrames.

Each round links every node's larger neighbours to its smallest one, then its smaller ones likewise; both are a
map-side combined minimum and a join, so a hub costs one row a map task, and edges never outgrow the input.
The minimum is a written table of its own, so the edges meet it in a plain join that can be broadcast, or split at a hub.
Rounds are written to the shared folder. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    down = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b")))


def _stars_only(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and no smaller end is a larger one elsewhere: a fixed point of both steps."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sums.where("up > 1 or (up > 0 and down > 0)").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = staged(now, "edges")
    while not _stars_only(now):
        now = staged(_small_star(staged(_large_star(now), "star")).distinct(), "star")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def extended(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) after further links (a, b): only edges between components are followed, each once."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    placed = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = placed.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    moves = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("now"))
    known = parts.join(moves, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    fresh = moves.join(parts.select(F.col("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("now").alias("component"))
    return staged(known.union(fresh), "parts")
