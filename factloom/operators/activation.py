"""Spreading activation over a weighted graph: each round is one join and one maximum a node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _spread(values: DataFrame, edges: DataFrame, damping: float) -> DataFrame:
    strength = F.lit(1) - F.lit(1) / (F.lit(1) + F.col("weight"))
    pushed = values.join(edges, F.col("node") == F.col("src"))
    return pushed.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("value") * strength * damping).alias("value"))


def _with_own(nodes: DataFrame, edges: DataFrame, damping: float) -> DataFrame:
    """(src, dst, factor): what an edge passes on, and each node to itself, so that a round reads its values once."""
    strength = F.lit(1) - F.lit(1) / (F.lit(1) + F.col("weight"))
    return edges.select("src", "dst", (strength * damping).alias("factor")).unionByName(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("factor")))


def _largest(*parts: DataFrame) -> DataFrame:
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("node").agg(F.max("value").alias("value"))


def activate(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 3, damping: float = 0.35, boost: float = 3.0) -> DataFrame:
    """(node, value): base values, seeds raised by ``boost``, spread for some rounds; the largest value wins.

    ``nodes`` is (node, value), ``edges`` directed (src, dst, weight), ``seeds`` (node); an
    unknown seed starts from 1.
    """
    raised = seeds.select("node").distinct().withColumn("_up", F.lit(boost))
    base = nodes.join(raised, "node", "full").select("node", (F.coalesce("value", F.lit(1.0)) + F.coalesce("_up", F.lit(0.0))).alias("value"))
    passed = _with_own(base.select("node").union(edges.select("dst")).distinct(), edges, damping)
    for _ in range(rounds):
        base = base.join(passed, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max(F.col("value") * F.col("factor")).alias("value"))
    return base


def activate_near(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 2, damping: float = 0.45, start: float = 4.0) -> DataFrame:
    """(node, value): only what the known seeds reach in some rounds, without base values."""
    front = seeds.select("node").distinct().join(nodes.select("node"), "node", "left_semi").withColumn("value", F.lit(start))
    active = front
    for _ in range(rounds):
        front = _spread(front, edges, damping)
        active = _largest(active, front)
    return active
