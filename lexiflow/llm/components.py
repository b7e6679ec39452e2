"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the smallest node of its component.

    Each round points nodes at the smallest neighbour they know, which halves the depth of the forest. It ends as soon as
    all components are stars, which the sums that begin a round tell: edges that are stars from the start need no round.
    The driver sees only whether there is another node. Rounds are written to the shared scratch folder, each in the
    place of the one before.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least ones are written, so that the joins share their shuffle with no aggregate and Spark can split a hot node.
        nearest = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above")), "least")
        # In a star a node has one smaller neighbour and no larger one, or none that is smaller.
        if nearest.filter("below > 1 OR below > 0 AND above > 0").isEmpty():
            break
        # Large star: larger neighbours of u, and u itself, to the smallest neighbour of u (or u). Repeats go with the next step's.
        large = both.filter("v > u").join(nearest.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(nearest.filter("u <> m").select("u", F.col("m").alias("v")))
        large = stored(large, "large")
        # Small star: smaller neighbours of u and u itself, to the smallest of them.
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        before, e = e, stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        for old in (before, nearest, large, least):
            discard(old)
    return nearest.select(F.col("u").alias("node"), F.col("m").alias("root"))
