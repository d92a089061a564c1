"""Connected components of a table of links, by alternating large and small stars; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for each node of links(a bigint, b bigint); nodes without links are absent."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        # a large star: neighbours above a node go to the least of it and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # a small star: neighbours below a node and the node go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, materialize(small.filter("a <> b").distinct(), "stars")
        discard(before)
        # stars only: no centre of one is a point of another, and no point has two centres
        chained = edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if chained.isEmpty() and edges.groupBy("a").count().filter("count > 1").isEmpty():
            break
    centres = edges.select(F.col("b").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(centres)
