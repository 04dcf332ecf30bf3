"""Evaluation and coverage measures, merges of evidence, and centroid classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Linearly interpolated median, 95th and 99th percentile of each group."""
    cut = lambda share: F.round(F.percentile(value, share), 6)
    return rows.groupBy(key).agg(F.count("*").alias("n"), cut(0.5).alias("p50"), cut(0.95).alias("p95"), cut(0.99).alias("p99"))


def density_bucket(count: Column) -> Column:
    return F.when(count < 3, count.cast("string")).when(count < 5, "3-4").when(count < 10, "5-9").otherwise("10+")


def density(groups: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(bucket, n_groups): histogram of facts a group; groups without facts count as 0."""
    counts = groups.select(key).join(facts.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    return counts.groupBy(density_bucket(F.coalesce("_n", F.lit(0))).alias("bucket")).agg(F.count("*").alias("n_groups"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n_rows, n_missing, missing_share): nulls and blanks of each column, in one pass."""
    missing = lambda c: F.sum(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", 1).otherwise(0))
    one = rows.agg(F.count("*").alias("n_rows"), *(missing(c).alias(f"_{c}") for c in columns))
    flat = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"_{c}"), F.lit(0)).alias("n_missing")) for c in columns))
    return one.select("n_rows", F.explode(flat).alias("f")).select("f.field", "n_rows", "f.n_missing", F.round(F.col("f.n_missing") / F.greatest("n_rows", F.lit(1)), 6).alias("missing_share"))


def classification(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: counts, precision and recall of a yes/no guess; null without a denominator."""
    hit = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    counts = rows.agg(hit(truth & guess).alias("tp"), hit(~truth & guess).alias("fp"), hit(truth & ~guess).alias("fn"), hit(~truth & ~guess).alias("tn"))
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return counts.withColumns({"precision": share("tp", "fp"), "recall": share("tp", "fn")})


def merged_evidence(edges: DataFrame, keys: list[str], source: str) -> DataFrame:
    """Edges of one key become one: support, sorted distinct sources, and whether sources corroborate."""
    out = edges.groupBy(*keys).agg(F.count("*").alias("support"), F.array_sort(F.collect_set(source)).alias("_s"))
    return out.select(*keys, "support", F.array_join("_s", "|").alias("sources"), (F.size("_s") > 1).cast("int").alias("corroborated"))


def merged_frontier(parts: list[DataFrame]) -> DataFrame:
    """(title, weight, sources) of (title, source, weight) parts: weights summed, distinct sources joined."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("title").agg(F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


def staleness(rows: DataFrame, key: str, when: str, today: str, windows: dict[str, int], kind: str) -> DataFrame:
    """(key, age_days, ratio, rank): age against the window of the row's kind, stalest first.

    Only the distinct ratios of a kind, no more than days, are put in order.
    """
    window = F.create_map(*(F.lit(x) for kv in windows.items() for x in kv))
    age = F.datediff(F.to_date(F.lit(today)), F.to_date(when))
    out = rows.select(key, kind, age.alias("age_days"), F.round(age / F.try_element_at(window, F.col(kind)), 6).alias("ratio"))
    counts = out.groupBy(kind, "ratio").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(kind).orderBy(F.desc("ratio")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(F.col(kind).alias("_kind"), F.col("ratio").alias("_ratio"), (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int").alias("rank"))
    return out.join(ranks, F.col(kind).eqNullSafe(F.col("_kind")) & F.col("ratio").eqNullSafe(F.col("_ratio"))).drop("_kind", "_ratio")


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, dim, value): mean of the unit vectors of a label, scaled to unit length; zero vectors take no part."""
    long = vectors.select(label, F.posexplode(unit(F.col(vector).cast("array<double>"))).alias("dim", "x"))
    mean = long.groupBy(label, "dim").agg(F.avg("x").alias("m"))
    norm = mean.groupBy(label).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, label).select(label, "dim", (F.col("m") / F.col("norm")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def nearest_centroid(vectors: DataFrame, centres: DataFrame, threshold: float, margin: float, key: str = "vec_id", vector: str = "embedding", most_labels: int = 10_000) -> DataFrame:
    """(key, best_label, best, second, decision): the label where best and its margin suffice, else abstain.

    ``centres`` is (label, dim, value). Labels are few by nature; more than ``most_labels`` are refused.
    """
    table = centres.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("c"))
    table = table.limit(most_labels + 1)
    refuse = F.raise_error(F.lit(f"more than {most_labels} labels"))
    near = table.agg(F.collect_list(F.struct("label", "c")).alias("all")).select(F.when(F.size("all") > most_labels, refuse.cast("array<struct<label:int,c:array<double>>>")).otherwise(F.col("all")).alias("all"))
    rows = vectors.select(key, unit(F.col(vector).cast("array<double>")).alias("v")).join(F.broadcast(near), how="cross")
    scored = F.transform("all", lambda s: F.struct(F.round(dot(F.col("v"), s["c"]), 6).alias("score"), (-s["label"]).alias("minus")))
    rows = rows.withColumn("_s", F.sort_array(scored, asc=False))
    best, second = F.col("_s")[0]["score"], F.coalesce(F.get("_s", F.lit(1))["score"], F.lit(-1.0))
    good = (best >= threshold) & (best - second >= margin)
    label = (-F.col("_s")[0]["minus"]).cast("int")
    return rows.select(key, label.alias("best_label"), best.alias("best"), second.alias("second"), F.when(good, "match").otherwise("abstain").alias("decision"))
