"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.shared import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that links lead to.

    Alternates large and small stars: each node hands its neighbours on to the smallest node that it knows,
    until every link leads to the smallest node of its component. Self-links and repeats do no harm;
    no links give an empty table.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        small = cut(small.filter("a <> b").distinct(), "small-star")
        # Finished when each node leads to one node, and that node to none.
        stuck = small.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a").union(small.select(F.col("b").alias("a")).distinct().join(small.select("a"), "a", "left_semi"))
        if stuck.isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("component")).union(small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        edges = small
