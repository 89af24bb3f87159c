"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventmill.plans.scratch import discard, materialize
from eventmill.plans.skew import heavy_keys, join_by_cells


def _least(edges: DataFrame) -> DataFrame:
    """``u, m, __n``: the least of each node's neighbours and their number."""
    return materialize(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n")), "least")


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges(u, v)`` with ``m``. The edges of a large star are dealt into cells."""
    return join_by_cells(edges, least.drop("__n"), ["u"], F.col("v"), heavy_keys(least, ["u"], "__n", total))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` (any direction) to ``(node, root)``; root is the least node of its component.

    Nodes without an edge do not appear. Each round costs two joins of the remaining
    edges; a component of diameter d needs about log2(d) rounds, a star at its least node none.
    """
    edges = materialize(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        count = edges.count()
        if not count:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = _least(both)
        # stars at their least nodes: every node with a lesser neighbour has no other one, and so that one is a root
        if near.where("m < u AND __n > 1").isEmpty():
            return near.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        large = _with_least(both, near, 2 * count).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large")
        tied = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        small = _with_least(large, _least(large), count).select(tied).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()
        before, edges = edges, materialize(small, "edges")
        discard(before, large, near)
    raise RuntimeError(f"components did not converge in {most_rounds} rounds")
