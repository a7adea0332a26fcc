"""Identities from aliases: which ids belong to one post."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identities(edges: DataFrame, materialise: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root): the smallest id that each id is linked with, over edges (a, b).

    Each round gives every id the smallest of its neighbours' roots and then the
    root of that root, so chains halve; materialise cuts the lineage of a round.
    Neighbours' roots are combined before they are shuffled.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("_near"))
        step = materialise(roots.join(near, "id").select("id", F.least("root", "_near").alias("new"), "root"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("_far"))
        next_ = materialise(step.join(jump, "new", "left").select("id", F.least(F.coalesce("_far", "new"), "new").alias("new"), "root"))
        if next_.where("new <> root").isEmpty():
            return next_.select("id", F.col("new").alias("root"))
        roots = next_.select("id", F.col("new").alias("root"))
