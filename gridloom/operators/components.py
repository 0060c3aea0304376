"""Connected components by contraction: hook every node to its least neighbour, flatten, relabel, repeat.

At least half of the nodes that still have edges vanish in each round, so rounds grow
with the logarithm of the graph. Every step is a join or a partial aggregation over
tables in the shared folder. Few parents (by a count) are broadcast; many are joined by a
shuffle, where a node with a third of all edges is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import GRAPH_BYTES, GRAPH_ROWS, cut
from gridloom.session import small as small_table


def small(df: DataFrame) -> DataFrame:
    return small_table(df, GRAPH_ROWS, GRAPH_BYTES)


def _flatten(parents: DataFrame) -> DataFrame:
    """Pointer jumping until every node's parent is a root (a node without a parent)."""
    while True:
        up = small(parents.select(F.col("node").alias("parent"), F.col("parent").alias("above")))
        jumped = cut(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the least node reachable.

    Self loops give their node a component of its own; null ends are ignored; repeated edges do no harm.
    """
    e = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).distinct())
    labels = None
    live = e.where("u != v")
    first = e
    while not live.isEmpty():
        parents = cut(live.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent")))
        parents = _flatten(parents)
        if labels is None:
            nodes = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            labels = nodes.join(small(parents), "node", "left").select("node", F.coalesce("parent", "node").alias("component"))
        else:
            up = small(parents.select(F.col("node").alias("component"), F.col("parent").alias("above")))
            labels = labels.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
        labels = cut(labels)
        pu = small(parents.select(F.col("node").alias("u"), F.col("parent").alias("pu")))
        pv = small(parents.select(F.col("node").alias("v"), F.col("parent").alias("pv")))
        moved = live.join(pu, "u", "left").join(pv, "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
        live = cut(moved.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if labels is None:
        return first.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return labels
