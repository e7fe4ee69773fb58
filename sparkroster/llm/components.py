"""Connected components of an edge table by contraction, on Spark alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised


def connected_components(edges: DataFrame) -> DataFrame:
    """`node, root` for every node of `edges(a, b)` (longs): the smallest node reachable.

    Each round every node takes as its parent the first, in order of a hash, of itself and its neighbours;
    edges are carried to the parents and those within one node vanish. The order is that of a hash so that
    a long chain falls into short pieces: rounds grow with the logarithm of its length. Every round's
    tables lie in the shared folder, so that none is computed twice. Loops and repeated edges do no harm;
    an empty table gives an empty one.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = _distinct(edges, "edges")
    roots = materialised(_both_ways(edges).select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "roots")
    if roots.isEmpty():
        return roots
    while not edges.isEmpty():
        first = _both_ways(edges).groupBy("a").agg(F.min(_in_order("b")).alias("first"))
        parents = first.where(F.col("first") < _in_order("a")).select(F.col("a").alias("child"), F.col("first.node").alias("parent"))
        parents = materialised(parents, "parents")
        roots = materialised(_moved(roots, "root", parents), "roots")
        edges = _distinct(_moved(_moved(edges, "a", parents), "b", parents), "edges")
    lowest = roots.groupBy("root").agg(F.min("node").alias("lowest"))
    return roots.join(lowest, "root").select("node", F.col("lowest").alias("root"))


def _in_order(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("hash"), F.col(node).alias("node"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def _distinct(edges: DataFrame, name: str) -> DataFrame:
    return materialised(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)


def _moved(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    joined = rows.join(parents, rows[column] == parents["child"], "left")
    return joined.select(*[F.coalesce("parent", column).alias(c) if c == column else c for c in rows.columns])
