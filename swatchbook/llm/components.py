"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swatchbook.cluster import written


def _jump(parents: DataFrame) -> DataFrame:
    """Every node's parent's parent; the hot parents are on the side that can be split."""
    above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
    return parents.join(above, "parent").select("node", F.col("_above").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of all nodes in ``links`` (two columns of one integer type).

    The component is its smallest node. Every round hangs each node below its
    smallest neighbour, shortens the paths, and moves the links to the upper
    ends; a link between a node and its parent moves with them, so nothing
    that was connected falls apart. Rounds go on until no link is left, each
    one a few grouped minima and joins; nodes with very many links are
    combined before the shuffle. Links with a null end are no links. All
    tables go to the shared folder, so a lost executor costs one round at most.
    """
    a, b = links.columns
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = written(edges.distinct(), "links")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    while not edges.isEmpty():
        lowest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low"))
        parents = lowest.select("node", F.least("node", "_low").alias("parent"))
        parents = written(_jump(written(parents, "parents")), "parents")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            up = parents.select(F.col("node").alias("component"), F.col("parent").alias("_up"))
            labels = written(
                labels.join(up, "component", "left").select(
                    "node", F.coalesce("_up", "component").alias("component")
                ),
                "labels",
            )
        at_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        at_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(at_a, "a").join(at_b, "b").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")
        )
        edges = written(moved.filter("a <> b").distinct(), "links")
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
