"""Connected components of link tables, by alternating large-star and small-star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import discard, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links lead to) for every node in ``links`` (a, b; longs).

    Nulls, self links and repeated links are let go. Each step joins the links with one row per node, so that no node's
    links meet in one task; steps end when nothing changes, after about as many as the logarithm of the longest path.
    """
    edges = written(_ordered(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # large star: the larger neighbours of a node go to its smallest
        large = _ordered(both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        old, edges = edges, written(_ordered(small), "links")
        discard(old)
        now = _state(edges)
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
            )
        state = now


def _state(edges: DataFrame) -> tuple:
    """The number of links and a sum over them, which tell whether a step has changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with the smaller node first."""
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
