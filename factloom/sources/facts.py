"""Facts: typed triples with stability, risk and time, derived from the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("ord", "subject", "predicate", "object", "stability", "risk", "temporal_class", "as_of")

#: The same view in SQL: each branch keeps its own scan, so a predicate prunes the others.
_BRANCHES = {
    "located_in": ("SELECT c_custkey AS ord, c_name AS subject, 'located_in' AS predicate, n_name AS object, 'stable' AS stability, 'low' AS risk, 'historical' AS temporal_class, '' AS as_of FROM customer JOIN nation ON c_nationkey = n_nationkey",
                   "SELECT 1000000000 + s_suppkey, s_name, 'located_in', n_name, 'stable', 'low', 'historical', '' FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "part_of": ("SELECT 2000000000 + n_nationkey, n_name, 'part_of', r_name, 'stable', 'low', 'historical', '' FROM nation JOIN region ON n_regionkey = r_regionkey",),
    "is_a": ("SELECT 3000000000 + p_partkey, 'part ' || p_partkey, 'is_a', p_type, 'stable', 'low', 'historical', '' FROM part",
             "SELECT 3500000000 + min(p_partkey), p_type, 'is_a', p_type || ' goods', 'stable', 'low', 'historical', '' FROM part GROUP BY p_type",
             "SELECT 3700000000 + min(p_partkey), p_type || ' goods', 'is_a', 'goods', 'stable', 'low', 'historical', '' FROM part GROUP BY p_type"),
    "published_by": ("SELECT 4000000000 + p_partkey, 'part ' || p_partkey, 'published_by', p_brand, 'stable', CASE WHEN p_size > 45 THEN 'high' ELSE 'low' END, 'historical', '' FROM part",),
    "owned_by": ("SELECT 5000000000 + o_orderkey, 'order ' || o_orderkey, 'owned_by', c_name, CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'volatile' ELSE 'semi_stable' END, 'low', CASE WHEN o_orderstatus = 'P' THEN 'snapshot' ELSE 'historical' END, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) ELSE '' END FROM orders JOIN customer ON o_custkey = c_custkey",),
}


def facts_sql(*predicates: str) -> str:
    """SELECT for the facts of some predicates, or of all."""
    return " UNION ALL ".join(b for p in predicates or _BRANCHES for b in (_named(x) for x in _BRANCHES[p]))


def _named(branch: str) -> str:
    return f"SELECT * FROM ({branch}) AS f({', '.join(COLUMNS)})"


def facts(spark: SparkSession, sf_dir: str, *predicates: str) -> DataFrame:
    """The facts of some predicates, or of all, as one DataFrame."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier", "nation", "region", "part", "orders")}
    text = facts_sql(*predicates)
    for t in tables:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (supplier, part) of all line items: the ``produces`` facts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object")).distinct()
