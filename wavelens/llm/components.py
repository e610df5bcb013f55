"""Connected components of a table of links by contraction.

Every node hooks to the smallest node around it, links between hooks make a
smaller graph, and so on until no link is left; composing the hooks labels every
node. Rounds are a logarithm of the longest path at most: after two rounds in
the order of ids, which settle stars, nodes are ordered by hash, so that a
constant share of them goes in every round whatever the shape. All tables stay in
the shared folder; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, join_unique


def _contract(scratch: Scratch, edges: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """(node, root): some node of its component for every node of the distinct
    edges (u, v); and the number of rounds."""
    both = edges.union(edges.select("v", "u")).toDF("node", "v")
    if turn < 2:
        low = F.least(F.col("node"), F.min("v"))
    else:
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        low = F.least(order("node"), F.min(order("v"))).getField("n")
    hooks = scratch.write(both.groupBy("node").agg(low.alias("root"), F.count("*").alias("weight")), "hooks")
    total = 2 * edges.count()
    side = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"), "weight")
    smaller = join_unique(join_unique(edges, side("u"), ["u"], "weight", total), side("v"), ["v"], "weight", total)
    smaller = smaller.where("ru <> rv").select(F.greatest("ru", "rv").alias("u"), F.least("ru", "rv").alias("v"))
    smaller = scratch.write(smaller.distinct(), "edges")
    hooks = hooks.select("node", "root")
    if not smaller.head(1):
        return hooks, turn + 1
    roots, turns = _contract(scratch, smaller, turn + 1)
    return hooks.join(roots.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), turns


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (columns a, b, long): the
    smallest node that it can reach. Nodes without a link to another are not in it."""
    edges = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    labelled, turns = _contract(scratch, edges, 0)
    if turns <= 2:  # in the order of ids the smallest node of a component is its last one
        return labelled.toDF("node", "component")
    labelled = scratch.write(labelled, "roots")
    least = labelled.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("weight"))
    return scratch.write(join_unique(labelled, least, ["root"], "weight", labelled.count()).select("node", "component"), "components")
