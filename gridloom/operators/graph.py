"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.scratch import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: neighbours are joined to the least of the node's neighbourhood."""
    if small:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sided = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = sided.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v long); a component is its least node.

    Every step is written to the shared folder, so its lineage is one read. Ends when a step
    changes nothing (equal count and checksum).
    """
    now = stored(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most):
        now = stored(_star(_star(now, False), True), "edges")
        new = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == (new["n"], new["x"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        mark = (new["n"], new["x"])
    raise RuntimeError("components did not settle")
