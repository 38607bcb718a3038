"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Tables


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to a root."""
    ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.lit(None).alias("b")))
    seen = ends.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count_if(F.col("b").isNull()).alias("above"))
    return seen.where("low <> high OR (low IS NOT NULL AND above > 0)").isEmpty()


def connected(tables: Tables, links: DataFrame, label: str) -> DataFrame:
    """(node, root) of every node in `links` (a, b); the root is the least node reachable.

    The rounds grow with the logarithm of a component's size. Least neighbours
    are written before they are joined, so Spark can split the rows of a node
    with very many neighbours. Links of a node with itself and repeated links
    do no harm; no links give an empty result.
    """
    edges = tables.save(f"{label}-edges-0", links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    step = 0
    while not _settled(edges):
        step += 1
        both = edges.union(edges.select("b", "a"))
        least = tables.save(f"{label}-large-{step}", both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = tables.save(f"{label}-edges-{step}-large", large)
        least = tables.save(f"{label}-small-{step}", edges.groupBy("a").agg(F.min("b").alias("m")))
        small = edges.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = tables.save(f"{label}-edges-{step}-small", small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
