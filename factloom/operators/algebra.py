"""The query algebra: Find, Filter, Count, Compare, Traverse, Classify, Aggregate over a facts DataFrame.

Each step is a function from DataFrames to a DataFrame; ``execute`` runs a list of steps
by name and stops with an audit where a Find or Filter comes back empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalize import hop_key, lookup_key
from factloom.functions.policy import hop_safe


def find(facts: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:
    """Safe facts of a subject, a predicate and an object; what is None matches all. Keys are normalized."""
    out = facts.where(hop_safe())
    for name, value, key in (("subject", subject, lookup_key), ("object", object, hop_key)):
        if value is not None:
            out = out.where(key(F.col(name)) == key(F.lit(value)))
    return out if predicate is None else out.where(F.col("predicate") == predicate)


def filter_metadata(rows: DataFrame, stability: str | None = None, temporal_class: str | None = None) -> DataFrame:
    for name, value in (("stability", stability), ("temporal_class", temporal_class)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def filter_secondary(rows: DataFrame, facts: DataFrame, predicate: str, object: str | None = None) -> DataFrame:
    """Rows whose object has a safe fact of ``predicate``; adds the sorted objects as secondary_objects."""
    second = find(facts, predicate=predicate, object=object)
    second = second.groupBy(hop_key(F.col("subject")).alias("_key")).agg(F.sort_array(F.collect_set("object")).alias("secondary_objects"))
    return rows.withColumn("_key", hop_key(F.col("object"))).join(second, "_key").drop("_key")


def compare(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Rows of a whose raw (predicate, object) is in b (intersection) or not (difference); bag semantics of a."""
    kind = {"intersection": "left_semi", "difference": "left_anti"}[how]
    return a.join(b.select("predicate", "object").distinct(), ["predicate", "object"], kind)


def compare_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: count_a, count_b and which is larger."""
    both = a.select(F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(b.select(F.lit(0), F.lit(1)))
    counts = both.agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long").alias("count_a"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("count_b"))
    larger = F.when(F.col("count_a") > F.col("count_b"), "a").when(F.col("count_a") < F.col("count_b"), "b").otherwise("equal")
    return counts.withColumn("larger", larger)


def traverse(facts: DataFrame, first: str, second: str, subject: str | None = None) -> DataFrame:
    """(subject, via, object): safe two-hop chains along two predicates."""
    one = find(facts, subject, first).select("subject", F.col("object").alias("via"), hop_key(F.col("object")).alias("_key"))
    two = find(facts, predicate=second).select(hop_key(F.col("subject")).alias("_key"), "object")
    return one.join(two, "_key").select("subject", "via", "object")


def aggregate(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, sorted distinct list, and first and last object by load order, for each group."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_distinct("object").alias("n_objects"),
        F.min_by("object", "ord").alias("earliest"),
        F.max_by("object", "ord").alias("latest"),
    )


def has_all(facts: DataFrame, predicates: list[str]) -> DataFrame:
    """(subject, n_present, missing): which of the predicates each subject lacks, for the AND query."""
    own = facts.where(hop_safe() & F.col("predicate").isin(*predicates)).groupBy("subject").agg(F.collect_set("predicate").alias("has"))
    missing = F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, predicates)), "has")), ",")
    return own.select("subject", F.size("has").cast("long").alias("n_present"), missing.alias("missing"))


def co_attribution(pairs: DataFrame) -> DataFrame:
    """(object, a, b, members): of each object that two subjects or more share, its least subject with every other one.

    Input is distinct (subject, object). A class of n subjects has n - 1 rows, which stand for all its pairs.
    """
    size = pairs.groupBy("object").agg(F.min("subject").alias("a"), F.count("*").alias("members")).where("members >= 2")
    return pairs.join(size, "object").where("subject != a").select("object", "a", F.col("subject").alias("b"), "members")


def co_attribution_of(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, shared): objects in common of each asked pair (a, b) of subjects that has some; input distinct (subject, object)."""
    asked = asked.select("a", "b").distinct()
    x = asked.join(pairs.withColumnRenamed("subject", "a"), "a")
    return x.join(pairs.withColumnRenamed("subject", "b"), ["b", "object"]).groupBy("a", "b").agg(F.count("*").alias("shared"))


def functionality(facts: DataFrame) -> DataFrame:
    """Per predicate: subjects, objects a subject on average, and the most."""
    own = facts.groupBy("predicate", "subject").agg(F.count_distinct("object").alias("k"))
    return own.groupBy("predicate").agg(F.count("*").alias("subjects"), F.round(F.avg("k"), 6).alias("avg_objects"), F.max("k").alias("max_objects"))


def conflicts(facts: DataFrame, allowed: float = 1.34) -> DataFrame:
    """(subject, predicate, first_object, second_object) of nearly functional predicates with two objects or more."""
    many = functionality(facts).where((F.col("subjects") >= 3) & (F.col("avg_objects") <= allowed) & (F.col("max_objects") < 3)).select("predicate")
    own = facts.join(many, "predicate", "left_semi").groupBy("subject", "predicate")
    own = own.agg(F.min("object").alias("first_object"), F.max("object").alias("second_object"))
    return own.where("first_object != second_object")


@dataclass(frozen=True)
class Step:
    """One step of a plan: an operation's name, its arguments, and the name of its result."""

    op: str
    name: str
    args: dict = field(default_factory=dict)


def execute(plan: list[Step], facts: DataFrame) -> tuple[str, DataFrame | None]:
    """("answer", result of the last step), or ("audit", None) if a Find or Filter is empty.

    All Finds and Filters are looked into in one job, by one row of each.
    """
    done: dict[str, DataFrame] = {}
    gates: list[DataFrame] = []
    for step in plan:
        args = {k: done[v[1:]] if isinstance(v, str) and v.startswith("$") else v for k, v in step.args.items()}
        if step.op in ("find", "traverse"):
            out = {"find": find, "traverse": traverse}[step.op](facts, **args)
        elif step.op == "filter_secondary":
            out = filter_secondary(facts=facts, **args)
        elif step.op == "count":
            out = args["rows"].agg(F.count("*").alias("n"))
        else:
            out = {"filter_metadata": filter_metadata, "compare": compare, "compare_size": compare_size, "aggregate": aggregate}[step.op](**args)
        if step.op in ("find", "filter_metadata", "filter_secondary"):
            gates.append(out.select(F.lit(len(gates)).alias("gate")).limit(1))
        done[step.name] = out
    if gates and reduce(DataFrame.unionAll, gates).count() < len(gates):
        return "audit", None
    return "answer", done[plan[-1].name]
