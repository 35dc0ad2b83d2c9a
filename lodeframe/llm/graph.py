"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or its smaller) neighbours and itself are tied to its least neighbour. Minima are combined before they are shuffled, so a hub costs no task more than its own edges."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    out = tied.filter(F.col("v") > F.col("u")) if large else tied
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, tables: Tables | None = None, parts: int | None = None) -> DataFrame:
    """node, comp (its least reachable node) for every node of an edge (u, v); a node without edges has no row. The rounds go on until nothing changes, about the logarithm of the longest path. An empty table gives no rows; edges from a node to itself are left out."""
    tables = tables or Tables(edges.sparkSession, "components")
    now = tables.write(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", parts)
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    last, found = None, sign(now)
    while found[0] and found != last:
        now = tables.write(_star(_star(now, True), False), "edges", parts)
        last, found = found, sign(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
