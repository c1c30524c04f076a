"""Connected components by repeated contraction, with all links and labels kept in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Components of undirected links.

    ``links``: columns ``a`` and ``b`` of one orderable type. Returns a written table ``node``, ``root``: one
    row for each node with a link, nodes of one component having one root (a member, not always the least).

    In each round every node points at its least neighbour or itself, pointers are doubled, and links are
    redrawn between what their ends point at. At least half of the nodes that still have links vanish in a
    round, so rounds grow with the logarithm of the nodes. Empty input gives an empty table; self links
    and repeated links are ignored; a node with only self links has no row.
    """
    work = scratch.cut(links.select("a", "b").where("a != b").distinct())
    labels = None
    while True:
        both = work.unionByName(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        parent = scratch.cut(parent.join(up, "p").select(F.col("a").alias("node"), F.col("q").alias("root")))
        if labels is None:
            labels = parent
        else:
            new = parent.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = scratch.cut(labels.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        ends = [parent.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab"]
        left = scratch.cut(work.join(ends[0], "a").select("b", "ra"))
        work = scratch.cut(left.join(ends[1], "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
        if work.isEmpty():
            return labels


def least_members(scratch: Scratch, links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root`` for all ``nodes`` (``node``): the least member of each one's component of the links ``a, b``."""
    found = connected_components(scratch, links)
    least = found.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("least"))
    named = scratch.cut(found.join(least, "root").select("node", F.col("least").alias("root")))
    return nodes.select("node").distinct().join(named, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
