"""Connected groups of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import checkpointed


def _state(links: DataFrame) -> tuple:
    """Number and hash of a set of edges, the same in any order."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())


def connected_groups(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): the root is
    the smallest node of its connected group. Nodes are any orderable type.

    Alternates two steps until no edge changes: every node links its larger
    neighbours to its smallest one, then its smaller neighbours and itself to the
    smallest of those. Both keep the groups; the number of rounds grows with the
    logarithm of the longest path. A node with many neighbours is only ever
    grouped by a partial aggregate (its minimum), and joined as an edge list.
    """
    links = checkpointed(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    before = _state(links)
    while True:
        # Large step: both directions, smallest of the neighbourhood and the node.
        both = links.select("v", "u").unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (
            both.filter(F.col("u") > F.col("v")).join(least, "v")
            .select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        )
        # Small step: every node links its smaller neighbours to the smallest.
        smallest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(smallest, "v").filter(F.col("u") != F.col("m"))
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .unionByName(smallest.select("v", F.col("m").alias("u")))
            .distinct()
        )
        links = checkpointed(small)
        state = _state(links)
        if state == before:
            break
        before = state
    roots = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
