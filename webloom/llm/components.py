"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import materialize


def _smallest(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` with the smallest ``b`` of each ``a``; a hot ``a`` combines before its shuffle.

    Both sides of the join are written tables: Spark's skew join splits a hub with a large part of the
    links, which it does not do where one side is an aggregate.
    """
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    return links.join(least, "a")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; the root is its smallest reachable node.

    Alternates two steps until nothing changes: each node's larger neighbours move to its smallest
    one, then its smaller ones do. Every half round is a written table, so plans stay short and a lost
    executor costs one of them. Null ends and loops are ignored.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(ends, "links")
    before = None
    while (state := _state(current)) != before:
        before = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(_smallest(both).where("b > a")
                            .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct(), "links")
        small = _smallest(large)
        moved = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = small.select("a", F.col("m").alias("b"))
        current = materialize(moved.unionByName(kept).distinct(), "links")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
