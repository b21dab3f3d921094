"""Connected components by repeated contraction.

Every round each node takes the smallest node next to it as its parent, follows
parents twice, and the graph shrinks to the parents. The smallest node of a
component never gets a parent, so it is what all its nodes end at. A round is a
few joins and sums on the node id; nothing is collected but one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.frames import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component): the smallest node reachable, for every linked node.

    Self links and nulls are left out; an empty input gives an empty result.
    """
    pairs = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    edges = _distinct(pairs)
    label = None
    while not edges.isEmpty():
        parents = stored(_parents(edges), "parents")
        edges = _distinct(_contracted(edges, parents))
        if label is None:
            label = parents.select("node", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            label = stored(
                label.join(up, "component", "left").select(
                    "node", F.coalesce("parent", "component").alias("component")
                ),
                "labels",
            )
    if label is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return label


def _distinct(pairs: DataFrame) -> DataFrame:
    low_first = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stored(low_first.distinct(), "links")


def _parents(edges: DataFrame) -> DataFrame:
    """(node, parent) of every node, after following parents twice."""
    both = edges.union(edges.select("b", "a"))
    smallest = both.groupBy("a").agg(F.min("b").alias("b"))
    first = smallest.select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
    second = first.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
    return first.join(second, "parent", "left").select(
        "node", F.coalesce("above", "parent").alias("parent")
    )


def _contracted(edges: DataFrame, parents: DataFrame) -> DataFrame:
    of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("to_a"))
    of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("to_b"))
    moved = edges.join(of_a, "a").join(of_b, "b")
    return moved.filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
