"""Connected components of a table of edges.

Every node points to the smallest of itself and its neighbours, and then, by steps that double, to where these pointers
lead. A round replaces the ends of all edges by what they point to; edges whose ends meet, and repeated ones, go, so that
a group of thousands of copies with dozens of edges each is a few nodes after one round, and a round at least halves the
nodes with edges. The rounds end when no edge is left; then the pointers are followed, last round first, a row per
node. Edges and pointers are checkpointed in every round. All joins read checkpointed tables directly, so
that a hub (a node with a third of all edges) is a skewed partition that Spark can split, and minima are
combined before they are shuffled. No table here has a bound, so the joins ask not to be broadcast. Only whether edges
are left, and pointers have changed, reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.freeze import freeze


def _followed(pointers: DataFrame) -> DataFrame:
    """(node, to): where the pointers lead that lead nowhere else."""
    while True:
        onward = pointers.select(F.col("node").alias("to"), F.col("to").alias("next"))
        further = freeze(pointers.join(onward.hint("merge"), "to"))
        pointers = further.select("node", F.col("next").alias("to"))
        if further.where("to <> next").isEmpty():
            return pointers


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node of an edge; ``component`` is the smallest node it can reach.

    Null ends, loops and repeated edges say nothing and are left out; a node whose edges are all loops is
    its own component."""
    ends = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna()
    ends = freeze(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while not rounds or not ends.isEmpty():
        told = ends.select("a", F.explode(F.array("a", "b")).alias("node"))
        pointers = _followed(freeze(told.groupBy("node").agg(F.min("a").alias("to"))))
        moved = freeze(ends.where("a <> b").join(pointers.select(F.col("node").alias("a"), F.col("to").alias("x")).hint("merge"), "a").select("x", "b"))
        moved = moved.join(pointers.select(F.col("node").alias("b"), F.col("to").alias("y")).hint("merge"), "b").where("x <> y")
        ends = freeze(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        rounds.append(pointers)
    found = rounds.pop()
    while rounds:
        onward = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = freeze(rounds.pop().join(onward.hint("merge"), "to", "left").select("node", F.coalesce("last", "to").alias("to")))
    return found.select("node", F.col("to").alias("component"))
