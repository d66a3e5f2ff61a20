"""Connected components of a graph whose edges are a table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) for every vertex u of the edges (u, v) but the least of its component, with v that least vertex.

    Rows with equal ends or a null are no edges.  Each round is written to the shared folder, so that a lost executor
    costs one round, and rounds stop when every vertex points at one that points nowhere.
    """
    edges = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        n, heads = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if n == heads and (n == 0 or edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()):
            return edges
        new = scratch.save(_small_star(_large_star(edges)), "edges")
        scratch.drop(edges)
        edges = new


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels, as components() gives them, after more links (u, v): only what the links join is worked on.

    The links' ends are replaced by their labels; the components of what is left, fewer rows than links, then replace the
    labels they hold.  ``labels`` itself is given back if the links join nothing new.
    """
    small = small_side(labels)
    at = links
    for c in ("u", "v"):
        at = at.join(small.select(F.col("u").alias(c), F.col("v").alias(f"l_{c}")), c, "left").withColumn(c, F.coalesce(f"l_{c}", c)).drop(f"l_{c}")
    joined = scratch.save(at.filter("u <> v"), "joined")
    if joined.isEmpty():
        scratch.drop(joined)
        return labels
    new = components(joined, scratch)
    moved = labels.join(small_side(new).select(F.col("u").alias("v"), F.col("v").alias("to")), "v", "left").select("u", F.coalesce("to", "v").alias("v"))
    out = scratch.save(moved.union(new), "labels")
    scratch.drop(joined, new)
    return out


def small_side(table: DataFrame) -> DataFrame:
    """A written table of two longs to join with: by a broadcast if it is small by count, by a shuffle beyond that."""
    return F.broadcast(table) if table.count() * 32 <= BROADCAST_BYTES else table.hint("merge")
