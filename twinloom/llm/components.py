"""Connected components by contraction: every vertex joins its smallest neighbour, and edges shrink to what still differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from twinloom.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): ``root`` is one node of its component, the same for all.

    Each round reads the edges left, so the work falls quickly; nothing but "are there edges left" reaches the driver.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        up = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        twice = up.join(up.select(F.col("node").alias("to"), F.col("to").alias("further")), "to", "left")
        up = cut(twice.select("node", F.coalesce("further", "to").alias("to")))
        moved = lambda df, c: df.join(up.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: E731, B023
        edges = moved(moved(edges, "a"), "b").where("a <> b")
        edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        roots = cut(moved(roots, "root"))
    return roots
