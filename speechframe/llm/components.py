"""Connected components by alternating large and small stars, on edge tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's component, for the nodes of edges (u, v). Loops and repeats are fine.

    Each round writes its edges to the shared folder, so a lost executor costs one round at most. Rounds grow with
    the logarithm of a component's size; `rounds` is only a guard, and running out of it raises an error.
    """
    with C.scratch(edges.sparkSession):
        roots = C.cut(_settled(edges, rounds), "roots", lasting=True)
    C.release(edges.sparkSession)
    return roots


def _settled(edges: DataFrame, rounds: int) -> DataFrame:
    edges = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    edges = C.cut(edges, "edges")
    before = None
    for _ in range(rounds):
        # Large star: every node hands its larger neighbours to its smallest one.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Small star: every node hands its smaller neighbours, and itself, to the smallest of them.
        low = large.select(F.col("v").alias("n"), F.col("u").alias("s"))
        least = low.groupBy("n").agg(F.min("s").alias("m"))
        small = low.join(least, "n").where("s <> m").select(F.col("m").alias("u"), F.col("s").alias("v"))
        edges = C.cut(small.unionByName(least.select(F.col("m").alias("u"), F.col("n").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max(F.xxhash64("u", "v"))).first()
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError("components did not settle")
