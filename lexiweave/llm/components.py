"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (node, root), a row for each node that has a link; root is the least node of its component.

    Each round every node points at its least neighbour if that is less than itself, pointers are jumped, links move to
    where their ends point, and those inside one root go. A node that is not least around it joins another, so links
    shrink fast; nothing is gathered outside the executors, and each round's outcome is stored in the shared folder.
    """
    left = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers")
        step = stored(_follow(least, least), "pointers")
        before = roots
        roots = step if roots is None else stored(_follow(roots, step).unionByName(step.join(roots, "node", "left_anti")), "roots")
        to = step.select(F.col("node").alias("a"), F.col("root").alias("_a")), step.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        moved = left.join(to[0], "a").join(to[1], "b").where("_a <> _b")
        now = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
        forget(left, least, before, None if step is roots else step)
        left = now
    forget(left)
    return links.sparkSession.createDataFrame([], "node long, root long") if roots is None else roots


def _follow(pointers: DataFrame, step: DataFrame) -> DataFrame:
    """Where the roots of `pointers` point in `step`."""
    onward = step.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return pointers.join(onward, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
