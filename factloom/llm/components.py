"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import dropped, written

#: Parts among which the edges of one node are dealt.
_SALTS = 64


def _mark(edges: DataFrame) -> tuple:
    # two independent sums of hashes and the count, all over the whole table
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("u", "v").cast("long"))).first())


def _with_least(edges: DataFrame, least: Column) -> DataFrame:
    """(u, v, m): each edge with its node's least end ``least``; a node's edges are dealt over salts, so none is gathered in one task."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)))
    parts = salted.groupBy("u", "_salt").agg(F.min("v").alias("v"))
    ends = parts.groupBy("u").agg(least.alias("m"))
    return salted.join(parts.select("u", "_salt").join(ends, "u"), ["u", "_salt"]).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge its least reachable node.

    Loops, nulls and repeated edges are let go; an empty table has no components. Every round is
    a table in the shared folder that replaces the one before. A node's edges are never gathered, only their least end.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    known = written(ends.distinct(), "edges")
    before = _mark(known)
    while before[0]:
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.first("u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, F.min("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        last, known = known, written(small.unionByName(own.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(last)
        after = _mark(known)
        if after == before:
            break
        before = after
    nodes = known.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
