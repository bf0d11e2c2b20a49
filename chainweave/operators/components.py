"""Connected components of an undirected graph (C2, C7), by contraction.

Each round gives every node the node of smallest hash within two steps (a fresh
hash in each round, so that long chains shrink by a constant share; a star
becomes one node at once) and replaces the edges by those between the chosen
nodes. The rounds' maps are then composed from the last to the first. Every
round ends in stored tables, so a lost executor costs one round's tasks at most,
and both sides of every join are read straight from storage: adaptive execution
can split the partition of a node with many neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of an edge; ``component`` is one of its nodes, the same for all of them.

    Self-loops make a node known; null ends are ignored; repeated edges do no harm.
    """
    scratch, rounds = Scratch(edges.sparkSession, "components"), 0
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    given = scratch.store(given.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    live = given.where("a <> b")
    while not live.isEmpty():
        live = _contracted(live, scratch, rounds)
        rounds += 1
    node = given.schema["a"].dataType.simpleString()
    chosen = lambda k: scratch.spark.read.schema(f"a {node}, to {node}").parquet(scratch.path(f"chosen-{k}"))
    alone = given.where("a = b").select("a")
    if not rounds:
        found = alone.select("a", F.col("a").alias("to"))
    else:
        found = chosen(rounds - 1)
        for k in reversed(range(rounds - 1)):
            up = found.select(F.col("a").alias("to"), F.col("to").alias("top"))
            found = scratch.store(chosen(k).join(up, "to", "left").select("a", F.coalesce("top", "to").alias("to")), f"found-{k}")
        found = found.unionByName(alone.join(found.select("a"), "a", "left_anti").select("a", F.col("a").alias("to")))
    found = scratch.store(found, "components")
    scratch.close("components")
    return found.select(F.col("a").alias("node"), F.col("to").alias("component"))


def _contracted(live: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """The edges between the nodes that round ``k`` chooses; its map is stored as ``chosen-k``."""

    def hashed(node: str) -> Column:
        return F.struct(F.xxhash64(node, F.lit(k)).alias("h"), F.col(node).alias("node"))

    ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # the smallest within one step; within two, over the neighbours (one of them is as small as the node's own)
    near = scratch.store(ends.groupBy("a").agg(F.min(hashed("b")).alias("m")).select("a", F.least("m", hashed("a")).alias("m")), f"near-{k}")
    around = ends.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
    chosen = scratch.store(around.select("a", F.col("m.node").alias("to")), f"chosen-{k}")
    ahead = live.join(chosen.select("a", F.col("to").alias("x")), "a").select("b", "x").join(chosen.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
    found = scratch.store(ahead.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"live-{k}")
    scratch.drop(f"near-{k}", *([f"live-{k - 1}"] if k else []))
    return found
