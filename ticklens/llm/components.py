"""Connected components of an edge table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours (the larger ones, or the smaller and itself) to its least neighbour."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = pairs.join(least, "a")  # a node with very many neighbours is a skewed key, which Spark splits
    if large:
        tied = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.filter("a <> b").distinct()


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """node, root (least node of its component) of every node of ``edges`` (columns a, b; longs).

    Every round is written to the shared folder; the rounds needed grow with the logarithm of the
    longest path.  Null ends and loops are dropped; no edges give no rows.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges")
    for k in range(rounds):
        before = edges
        edges = materialize(_star(_star(edges, True), False), f"{name}-stars{k}")
        # rows are distinct, so equal numbers and no new row mean the same table
        if edges.count() == before.count() and edges.join(before, ["a", "b"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
