"""Connected components of a distributed edge list by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, durable


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; the root is the smallest node reachable.

    Each round hooks a node to its smallest neighbour, follows the hooks to their roots by pointer
    doubling and keeps the edges between different roots, so the number of live nodes at least
    halves. A hub is only met by combinable minima and joins. Null ends and loops are ignored.
    """
    links = durable(edges.select("a", "b").where("a <> b").distinct())
    known = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = durable(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
                        .select("node", F.least("node", "near").alias("root")))
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            hooks = durable(hooks.join(up, "root").select("node", F.col("above").alias("root"),
                                                         (F.col("above") < F.col("root")).alias("moved")), replaces=hooks)
            if hooks.where("moved").isEmpty():
                break
        step = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        head = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        tail = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = durable(links.join(head, "a").join(tail, "b").where("ra <> rb")
                        .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), replaces=links)
        if known is None:
            known = hooks
        else:
            known = durable(known.join(step, "root", "left").select("node", F.coalesce("above", "root").alias("root")), replaces=known)
            discard(hooks)
    if known is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return known.select("node", "root")
