"""Connected components of large edge tables by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.plans.scratch import discard, written


def _settled(parents: DataFrame) -> DataFrame:
    """Point every node at its root. Parents are smaller than their nodes; roots have no row."""
    while True:
        up = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
        # both sides are written tables, so a parent that many nodes share is a splittable join key
        moved = written(parents.join(up.hint("merge"), parents["parent"] == up["_node"], "left").select("node", F.coalesce("_parent", "parent").alias("parent"), F.col("_parent").isNotNull().alias("moved")), "parents")
        discard(parents)
        if moved.filter("moved").isEmpty():
            return moved
        parents = moved


def _roots(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, those within one component dropped."""
    for end in ("a", "b"):
        p = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        edges = edges.join(p.hint("merge"), edges[end] == p["_n"], "left").withColumn(end, F.coalesce("_p", end)).drop("_n", "_p")
    return edges.filter("a <> b")


def components(edges: DataFrame, parents: DataFrame | None = None) -> DataFrame | None:
    """A written table (node, parent): the smallest node of each node's component.

    ``edges`` is a written table (a, b). Nodes that are the smallest of their
    component, or have no edge, have no row. ``parents`` carries on from an
    earlier result. Rounds grow with the logarithm of the longest chain. None if
    there is neither an edge nor a parent.
    """
    first = True
    while True:
        left = edges if first and parents is None else _roots(edges, parents)
        hooks = written(left.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("parent")).filter("node <> parent").groupBy("node").agg(F.min("parent").alias("parent")), "hooks")
        if hooks.isEmpty():
            return parents
        # old parents keep their rows; their roots now hook to smaller ones
        merged = hooks if parents is None else written(parents.select("node", "parent").unionByName(hooks), "merged")
        if parents is not None:
            discard(parents, hooks)
        parents = _settled(merged)
        first = False
