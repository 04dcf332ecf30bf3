"""Dialogue: salience of the entities of a conversation, and what a singular reference means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of salience, the recency penalty and its floor, and the margin of a reference.
LAST_ANSWER, LAST_QUESTION, USER_NAMED, MENTION, MENTION_CAP = 40, 30, 15, 3, 5
IDLE, IDLE_FLOOR, MARGIN = 12, -60, 25


def activations(turns: DataFrame, words: Column) -> DataFrame:
    """(conv_id, entity, mentions, last_turn, first_role, idle, in_answer, in_question) of each entity of a conversation.

    ``words`` are a turn's entities; idle counts turns since the last mention; the last
    answer and question are the last turns of assistant and user.
    """
    ends = turns.groupBy("conv_id").agg(
        F.max("turn").alias("_end"), F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_answer"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("_question"))
    rows = turns.select("conv_id", "turn", "role", F.explode(words).alias("entity"))
    seen = rows.groupBy("conv_id", "entity").agg(
        F.count("*").alias("mentions"), F.max("turn").alias("last_turn"), F.min_by("role", "turn").alias("first_role"),
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_a"), F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("_q"))
    both = seen.join(ends, "conv_id")
    hit = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return both.select("conv_id", "entity", "mentions", "last_turn", "first_role", (F.col("_end") - F.col("last_turn")).alias("idle"), hit("_a", "_answer").alias("in_answer"), hit("_q", "_question").alias("in_question"))


def salience() -> Column:
    """Points of an activation: last answer, last question, named by the user, idle turns, mentions."""
    points = lambda when, n: F.when(when, n).otherwise(0)
    return (
        points(F.col("in_answer"), LAST_ANSWER) + points(F.col("in_question"), LAST_QUESTION) + points(F.col("first_role") == "user", USER_NAMED)
        + F.greatest(F.lit(IDLE_FLOOR), -F.col("idle") * IDLE) + F.least("mentions", F.lit(MENTION_CAP)) * MENTION
    ).cast("long")


def singular(scored: DataFrame, margin: int = MARGIN) -> DataFrame:
    """(conv_id, entity, salience, decision): the most salient entity; ``ambiguous`` where the next is within ``margin``."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("salience"), "entity")
    two = scored.withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    out = two.groupBy("conv_id").agg(F.min_by("entity", "_k").alias("entity"), F.max("salience").alias("salience"), F.max(F.when(F.col("_k") == 2, F.col("salience"))).alias("_next"))
    clear = F.col("_next").isNull() | (F.col("salience") - F.col("_next") >= margin)
    return out.select("conv_id", "entity", "salience", F.when(clear, "resolved").otherwise("ambiguous").alias("decision"))
