"""Bounded recursion over facts: reachability and shortest paths, one equi-join a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.lineage import cut


def closure(edges: DataFrame, depth: int = 6) -> DataFrame:
    """(subject, object, hops): least number of hops from each subject to each object within ``depth``.

    ``edges`` has distinct (subject, object). Each level joins only the pairs that the one before found
    new, so cycles and hubs are not walked again; the search ends with the first empty level.
    """
    edges = cut(edges.select("subject", "object").where("subject != object"))
    step = edges.select(F.col("subject").alias("_from"), F.col("object").alias("_to"))
    level = edges.withColumn("hops", F.lit(1))
    known = level
    for hops in range(2, depth + 1):
        found = level.join(step, F.col("object") == F.col("_from")).select("subject", F.col("_to").alias("object")).where("subject != object").distinct()
        level = cut(found.join(known.select("subject", "object"), ["subject", "object"], "left_anti").withColumn("hops", F.lit(hops)))
        if level.isEmpty():
            break
        known = known.unionAll(level)
    return known


def shortest_paths(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, node, hops): least hops from each start over undirected edges, within ``depth``."""
    both = edges.select(F.col("subject").alias("_from"), F.col("object").alias("_to"))
    both = both.unionAll(both.select(F.col("_to"), F.col("_from"))).distinct()
    both = cut(both)
    level = cut(starts.select("start", F.col("start").alias("node")).distinct())
    known = level.withColumn("hops", F.lit(0))
    for hops in range(1, depth + 1):
        found = level.join(both, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        level = cut(found.join(known.select("start", "node"), ["start", "node"], "left_anti"))
        if level.isEmpty():
            break
        known = known.unionAll(level.withColumn("hops", F.lit(hops)))
    return known
