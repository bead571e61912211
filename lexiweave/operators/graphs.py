"""The language network as rows. Paths grow by one edge a round, from the pairs that the round before reached first, so each pair is met
once however many walks lead to it. Rounds are as many as the longest shortest path has edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """df, computed once: in the checkpoint folder where there is one, else held by executors, which can make it again."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def shortest_paths(edges: DataFrame) -> DataFrame:
    """src, dst, hops and path of the shortest path of each pair that has one; of equals the one whose edges were added first.

    edges: ord, src, dst. Edges from a node to itself, and all but the first between two nodes, change nothing; nulls lead nowhere.
    """
    steps = _kept(edges.where("src <> dst").groupBy("src", "dst").agg(F.min("ord").alias("ord")))
    reached = steps.select("src", "dst", F.array("ord").alias("ords"), F.array("src", "dst").alias("path"))
    found = reached
    onward = steps.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("ord").alias("by"))
    while not reached.isEmpty():
        # a least path ends in an edge after a least path, so only the best of each pair goes on
        longer = reached.join(onward, "dst").where("src <> to")
        best = F.min(F.struct(F.concat("ords", F.array("by")).alias("ords"), F.concat("path", F.array("to")).alias("path"))).alias("b")
        new = longer.groupBy("src", F.col("to").alias("dst")).agg(best).select("src", "dst", "b.ords", "b.path")
        reached = _kept(new.join(found.select("src", "dst"), ["src", "dst"], "left_anti"))
        found = found.unionAll(reached)
    return found.select("src", "dst", F.size("ords").alias("hops"), "path")


def descendants(edges: DataFrame) -> DataFrame:
    """node and other: all that a node leads to, without itself."""
    return shortest_paths(edges).select(F.col("src").alias("node"), F.col("dst").alias("other"))


def ancestors(edges: DataFrame) -> DataFrame:
    """node and other: all that lead to a node, without itself."""
    return shortest_paths(edges).select(F.col("dst").alias("node"), F.col("src").alias("other"))


def has_path(edges: DataFrame, src: str, dst: str) -> bool:
    return src == dst or not descendants(edges).where((F.col("node") == src) & (F.col("other") == dst)).isEmpty()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_ancestors, n_descendants and the size a chart gives it."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    pairs = shortest_paths(edges)
    up = pairs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_ancestors"))
    down = pairs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_descendants"))
    out = nodes.join(up, "node", "left").join(down, "node", "left").na.fill(0, ["n_ancestors", "n_descendants"])
    return out.withColumn("size", F.greatest(F.lit(2), F.least(F.lit(20), F.col("n_ancestors") + F.col("n_descendants"))))
