"""Connected components over tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.store import forget, shared_dir, written

__all__ = ["connected_components", "forget", "shared_dir", "written"]


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre, or hangs on one centre alone."""
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("leaf")).union(edges.select(F.col("b").alias("n"), F.lit(0).alias("leaf")))
    odd = roles.groupBy("n").agg(F.sum("leaf").alias("as_leaf"), F.min("leaf").alias("low")).where("as_leaf > 1 or (as_leaf > 0 and low = 0)")
    return odd.isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns ``node``, ``component``.

    Alternates large-star and small-star steps. Each step needs the minimum neighbour of a node, which is
    aggregated before the shuffle, and one equi-join that adaptive execution may split, so a hub with a third
    of all edges doesn't land in one task; steps end once all that is left are stars around each class's smallest node. Null ends and self-loops carry no link. An empty input gives no row.
    """
    pairs = (
        edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
        .where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
        .distinct()
    )
    cur = written(pairs, "cc")
    while not _are_stars(cur):
        # large star: every neighbour above a node hangs on the node's smallest neighbour
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = (
            large.join(least, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a != b")
            .distinct()
        )
        nxt = written(small, "cc")
        forget(cur)
        cur = nxt
    nodes = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
