"""Connected components of a table of links, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _small(edges: DataFrame, stages: common.Stages) -> DataFrame:
    """edges (u, v), u > v: the neighbours below a node, and the node, go to the least of them."""
    # written, so that the join with a hub's rows can be split
    least = stages.put(edges.groupBy("u").agg(F.min("v").alias("m")))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, stages: common.Stages, most: int = 60) -> DataFrame:
    """(id, comp) for every id of links (a, b): comp is the least id that can be reached.

    A large star sends the neighbours above each node to the least node around it, a small star those below. Each round writes its
    edges to the shared folder; it ends when every node has either only neighbours above it or a single one below. A group's hub
    may hold a third of all links: its row counts are summed before they are dealt out, and the joins can be split.
    """
    edges = stages.put(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most):
        below, above = F.count_if(F.col("v") < F.col("u")), F.count_if(F.col("v") > F.col("u"))
        around = _both(edges)
        least = stages.put(around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), ((below > 1) | ((below > 0) & (above > 0))).alias("open")))
        if least.filter("open").isEmpty():
            out = stages.put(least.select(F.col("u").alias("id"), F.col("m").alias("comp")))
            stages.drop(edges, least)
            return out
        large = stages.put(around.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        new = stages.put(_small(large, stages))
        stages.drop(edges, least, large)
        edges = new
    raise RuntimeError("the components didn't settle")
