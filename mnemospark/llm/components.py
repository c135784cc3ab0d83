"""Distributed connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import materialize, split_join


def _star(edges: DataFrame) -> DataFrame:
    """For every node u with smallest neighbour m: link each neighbour v (kept by the caller) to m."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    return split_join(edges, smallest, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _star(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return linked.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star = _star(down)
    return star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is the smallest node that links reach.

    Self-links and null ends are ignored, direction and repeats do not matter, no links give an empty frame. Each
    round is written as a table; the rounds grow with the logarithm of the longest path. Only a count and a sum of
    hashes per round reach the driver.
    """
    links = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"))
    edges = materialize(links.distinct(), links.count())
    state = F.struct(F.count("*").alias("rows"), F.sum((F.xxhash64("u", "v") % 1_000_000_007).cast("decimal(38,0)"))).alias("state")
    now, before = edges.agg(state).first().state, None
    while now.rows and now != before:
        edges, before = materialize(_small_star(_large_star(edges)), now.rows), now
        now = edges.agg(state).first().state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
