"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) with the smallest b of each a as m, the table of these): a hub's pairs do not meet in one task."""
    low = cut(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    return hot_join(pairs, low, ["a"], "n").drop("n"), low


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """node, root: each node of an edge with the smallest node of its component.

    A step links each node's neighbours to the smallest of them, so a component of n nodes becomes a star in about
    log(n) rounds, whatever its shape. Minima are combined before the shuffle, edges stay as many as they were at most,
    and each round is written to the shared folder. A hub's edges meet its one minimum by hot_join().
    """
    e = edges.filter(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).distinct()
    e = cut(e, "edges")
    state = _state(e)
    while state[0]:
        near, _ = _with_least(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = cut(near.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct(), "large")
        near, low = _with_least(large)
        small = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = cut(small.distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
