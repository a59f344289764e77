"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.session import checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node it reaches.

    In each round every node takes the name of its smallest neighbour, and the
    edges between names go on to the next round, until none is left.  Sums are
    partial before the shuffle, so a node may have any number of edges; joins
    are inner or left joins by node, which Spark divides where a node is hot.
    Each round is checkpointed.  No edges: no rows.
    """
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = both.filter("a <> b").distinct().checkpoint()
    maps: list[DataFrame] = []
    while not now.isEmpty():
        names = now.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).checkpoint()
        maps.append(names)
        here, there = names.select("a", F.col("m").alias("ma")), names.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        now = now.join(here, "a").join(there, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).filter("a <> b").distinct().checkpoint()
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)

    def compose(known: DataFrame, names: DataFrame) -> DataFrame:
        step = names.select(F.col("a").alias("component"), "m")
        return known.join(step, "component", "left").select("node", F.coalesce("m", "component").alias("component"))

    first = maps[0].select(F.col("a").alias("node"), F.col("m").alias("component"))
    return reduce(compose, maps[1:], first).checkpoint()
