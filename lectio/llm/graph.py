"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``: the smallest node it can reach, itself included.

    Each round joins edges with one minimum per node, so no group is gathered; the minimum is combined
    before the shuffle and Spark's skew join splits a hot centre. Rounds grow with the logarithm of the
    longest path. Every round's edges are written to the shared folder. Edges with a null end and loops
    count for nothing; repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    now = scratch.cut(_ordered(edges.select("u", "v")), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.cut(_ordered(rest.unionByName(least.select("u", F.col("m").alias("v")))), "edges")
        was, mark = mark, _mark(new)
        scratch.drop(spark, now)
        now = new
        if mark == was:
            break
    own = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return own.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and checksum of the edges: equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))), F.lit(0))).first())
