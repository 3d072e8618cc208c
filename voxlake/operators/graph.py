"""Connected components of an edge table by contraction; everything stays in tables.

Each round hooks every vertex to its smallest neighbour, jumps pointers until they rest on roots, and
contracts the edges to roots; it ends when no edge is left.  Only emptiness tests reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.storage import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b of one orderable type (any order, repeats allowed).

    One row per vertex that has an edge: node, label (its component's smallest node).
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "parents")
        while True:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("next"))
            jumped = written(parent.join(up, "label").select("node", "label", "next"), "jump")
            moved = not jumped.where("next <> label").isEmpty()
            parent = jumped.select("node", F.col("next").alias("label"))
            if not moved:
                break
        if labels is None:
            labels = parent
        else:
            step = parent.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        ends = parent.select(F.col("node").alias("a"), F.col("label").alias("la"))
        other = parent.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        rest = e.join(ends, "a").join(other, "b").where("la <> lb")
        e = written(rest.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct(), "edges")
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
