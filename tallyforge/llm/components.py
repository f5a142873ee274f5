"""Connected components by alternating large and small stars.

Each round joins every node with the least of its neighbours; no neighbour list is ever
gathered, so a node with very many edges is a skewed join that Spark splits and an
aggregate that is combined before the shuffle.  Rounds are written to the shared
scratch folder.  The number of rounds grows with the logarithm of the largest diameter;
one aggregate shows that all edges are stars, so no round only confirms the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.scratch import materialize

MAX_ROUNDS = 60


def _ordered(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )


def _is_settled(edges: DataFrame) -> bool:
    """Whether ordered, distinct edges are stars: who has an edge down has one, and none up."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return counts.filter("down > 1 or down + up > 1").count() == 0


def _contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The edges between components: a node that is in one stands for itself no more."""
    for end in ("a", "b"):
        found = groups.select(F.col("node").alias(end), F.col("component").alias("__component"))
        edges = edges.join(found, end, "left").withColumn(end, F.coalesce("__component", end))
        edges = edges.drop("__component")
    return edges.select("a", "b")


def connected_components(edges: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """`node` and `component` (its least node) for every node of the edges `a`, `b`.

    `groups` is what was found for earlier edges, which then count too: only the edges
    between its components are worked on.  An edge from a node to itself adds no row.
    """
    now = materialize(_ordered(_contracted(edges, groups) if groups is not None else edges), "edges")
    for _ in range(MAX_ROUNDS):
        if _is_settled(now):
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")
        )
        large = materialize(large.filter("a != b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
            F.col("m").alias("b"),
        )
        # The node itself, where its edge to the least one is not among the others.
        now = materialize(_ordered(small), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
    if groups is None:
        return found
    joined = groups.join(found.toDF("component", "__least"), "component", "left").select(
        "node", F.coalesce("__least", "component").alias("component")
    )
    # A component's least node is in both.
    return joined.unionByName(found).distinct()
