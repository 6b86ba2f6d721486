"""Joins that Spark can split at hot keys, and connected components by alternating large-star and small-star steps, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """An equi-join whose hot keys Spark can split when it runs.

    Adaptive execution splits a hot partition only if both sides come straight
    from exchanges that the join itself asked for; where ``right`` is an aggregate
    by the same keys, Spark would reuse its partitioning instead. So the join is on
    expressions of the keys, at the price of one more exchange of ``right``. Only
    hash joins or sort-merge joins result, as Spark sees fit.
    """
    kinds = dict(right.dtypes)

    def key(col: F.Column, kind: str) -> F.Column:
        return col.bitwiseXOR(F.lit(0x5DEECE66D)) if kind == "bigint" else F.concat(col, F.lit("" if kind == "string" else b""))

    rights = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    match = None
    for c in on:
        a, b = key(left[c], kinds[c]), key(rights[f"__r_{c}"], kinds[c])
        one = a.eqNullSafe(b) if null_safe else a == b
        match = one if match is None else match & one
    return left.join(rights, match, how).drop(*[f"__r_{c}" for c in on])


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for each node of ``edges`` (u, v: long): root is the smallest node it is linked to.

    A step sends each node's neighbours to the smallest of them; only minima
    and edges move, hot nodes are split by the join, and each round is a table in the
    shared folder. What the driver sees is a count and a checksum. Rounds grow as
    the logarithm of the longest path at most squared.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = skewed_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = skewed_join(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.drop(large)
        scratch.drop(now)
        now = small
        # nodes move only to smaller roots, so the sum of exact sums falls until nothing changes
        got = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = got
