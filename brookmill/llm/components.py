"""Connected components by alternating large and small stars.

Each round rewires edges towards the smallest neighbour, first from every node to its
larger neighbours, then to its smaller ones, until all edges are stars around the smallest
node of their component.  The number of rounds grows with the logarithm of the size.
Minima are pre-aggregated before they are shuffled.  The edges of one node meet its minimum in
one task of a join, as a sorted stream of two ids each, which Spark's skew join does not cut (the
minimum is aggregated after its exchange); so the edges of the largest component's centre are one
task's work, though not in memory.  Each round is written to the shared folder, so that a lost executor
costs one round at most.  Only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type).

    ``component`` is the smallest node reachable.  Loops and edges with a null end are
    ignored; repeated edges count once; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = written(pairs, "edges", pairs=True)
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(small.union(least.select("hi", "m")).distinct(), "edges", pairs=True)
        before, state = state, _state(now)
        if state == before:
            break
    nodes = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return nodes.union(now.select("lo", "lo").distinct())
