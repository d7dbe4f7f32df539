"""Connected components by contraction, over edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import is_empty, written


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _compressed(hooks: DataFrame) -> DataFrame:
    """Point every node of a forest at its root by pointer doubling."""
    hooks = written(hooks.select("u", "p", F.lit(True).alias("moved")), "hooks")
    while not is_empty(hooks.where("moved")):
        up = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
        hooks = written(hooks.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "hooks")
    return hooks.select("u", "p")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the component's smallest node.

    Each round hooks every node to its smallest smaller neighbour, contracts the forest and keeps
    the edges between its roots, so the edge table at least halves its nodes each time. Tables are
    written between rounds; joins are on plain scans, which lets skewed keys be split at run time.
    An empty edge table gives an empty result; self loops are ignored.
    """
    edges = written(_ordered(edges), "edges")
    found = None
    while not is_empty(edges):
        hooks = _compressed(edges.groupBy("u").agg(F.min("v").alias("p")))
        if found is None:
            found = hooks
        else:
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
            found = written(found.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p")).unionByName(hooks), "found")
        at_u = hooks.select("u", F.col("p").alias("pu"))
        at_v = hooks.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(at_u, "u").join(at_v, "v", "left")
        edges = written(_ordered(moved.select(F.col("pu").alias("u"), F.coalesce("pv", "v").alias("v"))), "edges")
    if found is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = found.select("p").distinct().select(F.col("p").alias("node"), F.col("p").alias("root"))
    return found.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(roots)
