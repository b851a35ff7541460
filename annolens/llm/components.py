"""Connected components as a distributed union-find, by DataFrame operations only.

Randomised contraction: in each round every node points to the neighbour (or
itself) of least hash, edges are carried over to those representatives, and
loops and repeats go.  The number of nodes with edges falls by a constant
factor in a round, whatever the shape of the graph, so a few rounds do.  Each
round's pointers are written; the labels are then read back through them, from
the last round to the first.

A node with very many neighbours is harmless: its least neighbour comes from a
map-side aggregate, and the joins have one row per node on one side, so that
adaptive execution can split the other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolens.llm.common import drop_written, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Map every node of ``edges`` (a, b) to the smallest node of its component.

    Returns (node, root).  Loops and repeated edges are allowed; an edge with a
    null end is ignored; a node only in loops is a component of its own and is
    not listed.  No edges give an empty result.
    """
    def tidy(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    levels: list[DataFrame] = []
    current = written(tidy(edges.select("a", "b")), f"{name}-edges")
    while not current.isEmpty():
        seed = F.lit(len(levels))
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("to"))).alias("best"))
        own = F.struct(F.xxhash64("node", seed).alias("h"), F.col("node").alias("to"))
        pointers = written(best.select("node", F.least(own, "best")["to"].alias("to")), f"{name}-pointers")
        levels.append(pointers)
        left = pointers.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        right = pointers.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = current.join(left, "a").join(right, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        following = written(tidy(moved), f"{name}-edges")
        drop_written(current)
        current = following
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).where(F.lit(False))
    labels = levels[-1].select("node", F.col("to").alias("root"))
    for pointers in reversed(levels[:-1]):
        above = labels.select(F.col("node").alias("to"), F.col("root").alias("above"))
        labels = pointers.join(above, "to", "left").select("node", F.coalesce("above", "to").alias("root"))
    labels = written(labels, f"{name}-labels")
    for pointers in levels:
        drop_written(pointers)
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    return labels.join(least, "root").select("node", F.col("least").alias("root"))
