"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by with partial aggregation and an equi-join, so a hub is split by skew-join handling, and
the edge table is written to the shared checkpoint folder each round. Rounds go on until every component is a star, as
many as the logarithm of the longest chain; edges that are stars from the start need none. Nothing is gathered on the
driver but two counts.

Defined cases: an edge with a null end links nothing; loops and repeated edges count once; no edges give no rows; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import checkpointed, part


def _linked_to_least(edges: DataFrame, low: str, high: str) -> DataFrame:
    """least: for each node ``low``, the smallest of it and its neighbours ``high``; joined to its edges."""
    least = edges.groupBy(low, part(F.col(low))).agg(F.min(high).alias("least")).select(F.col(low).alias("node"), F.least(low, "least").alias("least"))
    return edges.join(least, edges[low] == least["node"])


def _stars(edges: DataFrame) -> bool:
    """Whether each node is linked to one below it at most, and that one to none."""
    n = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k")).first()
    return n["n"] == n["k"] and edges.join(edges.select(F.col("b").alias("center")).distinct(), F.col("a") == F.col("center"), "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b) but the smallest of its component, which is the component. Loops and repeats are allowed."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not _stars(edges):
        # large star: each neighbour above a node is linked to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _linked_to_least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: a node and its neighbours below it are linked to the least of them
        near = _linked_to_least(large, "a", "b")
        small = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(near.select("a", F.col("least").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
