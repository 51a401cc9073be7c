"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state_io import Kept


def components(links: DataFrame, kept: Kept) -> DataFrame:
    """(id, root): the least id that each id of links (a, b) is connected with; ids of no link aren't there.

    Large star: what is greater than a node is linked to the least around it. Small star: what is less is linked to it too. Rounds grow with
    the logarithm of the longest path. A node's neighbours are never gathered: their least is an aggregate that is joined back, so
    a node with many links is split like any join.
    """
    edges = kept.put(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = kept.put(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = kept.put(small.filter("a <> b").distinct())
        kept.drop(large)
        changed = new.exceptAll(edges).limit(1).count() or edges.exceptAll(new).limit(1).count()
        kept.drop(edges)
        edges = new
        if not changed:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
