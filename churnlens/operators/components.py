"""Connected components of an edge table by repeated contraction, all as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.sources.staging import staged

MAX_ROUNDS = 60


def _ordered(node: str):
    """A node behind its hash: an order that has nothing to do with the ids, so that no path of ids in order takes long."""
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of the edges a, b (longs): root is the least node reachable.

    Each round hooks every node to the least, by hash, of itself and its neighbours, and goes on with the edges among what
    they are hooked to: nodes about halve, and a star is gone in two rounds. The neighbours of a hot node are combined before
    they are shuffled; the joins that relabel edges are plain ones of two staged tables, so that adaptive execution can
    split a hot node's edges over tasks. Self-loops and repeated edges do no harm; null ends are dropped.
    """
    now = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not now.isEmpty():
        if len(rounds) == MAX_ROUNDS:
            raise RuntimeError("components did not settle")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_ordered("b")).alias("least"))
        hooks = staged(least.select(F.col("a").alias("node"), F.least(_ordered("a"), "least")["node"].alias("label")))
        rounds.append(hooks)
        ends = now
        for end in "ab":
            ends = ends.join(hooks.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("label", f"_{end}")
        now = staged(ends.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if not rounds:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1].withColumnRenamed("label", "root")
    for hooks in reversed(rounds[:-1]):
        further = found.select(F.col("node").alias("label"), "root")
        found = hooks.join(further, "label", "left").select("node", F.coalesce("root", "label").alias("root"))
    found = staged(found)
    named = found.groupBy("root").agg(F.min("node").alias("name"))
    return found.join(named, "root").select("node", F.col("name").alias("root"))
