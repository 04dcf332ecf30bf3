"""Evidence-scoped answer plans: a greedy walk over facts, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalize import hop_key
from factloom.operators.text import tokens

# Weights, thresholds, and words that carry no content.
RELEVANCE, QUALITY, CORROBORATION, CONNECTIVITY, GAIN, DIVERSITY, REDUNDANCY, LENGTH = 0.25, 0.20, 0.10, 0.20, 0.25, 0.10, 0.25, 0.05
FIRST_TOTAL, NEXT_TOTAL, LEAST_GAIN = 0.35, 0.34, 0.25
AT_TARGET, AT_NODE, ONE_SOURCE = 1.0, 0.8, 0.5
EMPTY_WORDS = ("the", "and", "for", "with", "from", "which", "where", "what", "who", "how")


def content_words(text: Column) -> Column:
    """Distinct words of three letters or more, without empty ones."""
    return F.array_distinct(F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~t.isin(*EMPTY_WORDS)))


def quality() -> Column:
    """0.4 for evidence, more for a stable fact and for a low risk."""
    stable = F.when(F.col("stability") == "stable", 0.30).when(F.col("stability") == "semi_stable", 0.20).otherwise(0.05)
    risk = F.when(F.col("risk") == "low", 0.30).when(F.coalesce("risk", F.lit("")).isin("", "medium"), 0.15).otherwise(0.0)
    return F.least(F.lit(0.40) + stable + risk, F.lit(1.0))


def edges(facts: DataFrame) -> DataFrame:
    """(node, ord, predicate, next, words, payload, quality): each fact at its subject.

    At its object a fact adds no word that the walk doesn't have, so it can't reach the least gain.
    """
    sentence = F.concat_ws(" ", "subject", "predicate", "object")
    return facts.select(
        hop_key(F.col("subject")).alias("node"), "ord", "predicate", hop_key(F.col("object")).alias("next"),
        content_words(sentence).alias("words"), content_words(F.col("object")).alias("payload"), quality().alias("quality"),
    ).where("node IS NOT NULL AND predicate IS NOT NULL AND next IS NOT NULL")


def _total(step: int) -> Column:
    shared = F.size(F.array_intersect("terms", "words"))
    relevance = F.when(F.size("terms") > 0, shared / F.greatest(F.lit(1), F.least(F.size("terms"), F.size("words")))).otherwise(F.lit(0.0))
    near = F.when(F.col("node") == F.element_at("nodes", 1), AT_TARGET).otherwise(AT_NODE)
    fresh = F.when(F.array_contains("used", F.concat_ws("|", "node", "predicate")), 0.0).otherwise(1.0)
    total = (
        RELEVANCE * relevance + QUALITY * F.col("quality") + CORROBORATION * F.lit(ONE_SOURCE) + CONNECTIVITY * near
        + GAIN * F.col("gain") + DIVERSITY * fresh - REDUNDANCY * (1 - F.col("gain")) - F.lit(LENGTH * step)
    )
    wanted = F.lit(True) if step else shared > 0
    return F.when(wanted, F.round(total, 6))


def answer_plans(facts: DataFrame, questions: DataFrame, blocks: int = 4) -> DataFrame:
    """(question_id, plan, totals): the facts that answer each question, best first, ``blocks`` at most.

    ``questions`` is (question_id, target, text). Each step takes the fact of the largest
    total at a node reached so far, ties to the smaller ord; a total or gain under its
    threshold, or a first step without a shared word, ends the plan. One join and one
    aggregation a step serve all questions. Questions without a target, or without facts, have an empty plan.
    """
    graph = edges(facts)
    empty = F.array().cast("array<string>")
    state = questions.select(
        "question_id", content_words(F.col("text")).alias("terms"), content_words(F.col("target")).alias("covered"),
        F.array(F.coalesce(hop_key(F.col("target")), F.lit(""))).alias("nodes"), empty.alias("used"),
        F.array().cast("array<bigint>").alias("plan"), F.array().cast("array<double>").alias("totals"),
    )
    kept = ("terms", "covered", "nodes", "used", "plan", "totals")
    for step in range(blocks):
        reached = state.withColumn("node", F.explode("nodes")).withColumn("_open", F.size("plan") == step)
        found = reached.join(graph, "node", "left").withColumn("gain", F.size(F.array_except("payload", "covered")) / F.greatest(F.lit(1), F.size("payload")))
        fits = F.col("_open") & F.col("ord").isNotNull() & ~F.array_contains("plan", F.coalesce("ord", F.lit(-1)))
        found = found.withColumn("total", F.when(fits, _total(step)))
        best = F.max_by(F.struct("ord", "node", "predicate", "next", "payload", "gain", "total"), F.struct("total", -F.col("ord")))
        found = found.groupBy("question_id").agg(*(F.first(c).alias(c) for c in kept), F.max("total").alias("_top"), best.alias("b"))
        good = F.coalesce((F.col("_top") >= (NEXT_TOTAL if step else FIRST_TOTAL)) & (F.col("b.gain") >= LEAST_GAIN), F.lit(False))
        grown = {
            "covered": F.array_union("covered", "b.payload"), "nodes": F.array_union("nodes", F.array("b.next")),
            "used": F.array_union("used", F.array(F.concat_ws("|", "b.node", "b.predicate"))),
            "plan": F.array_append("plan", F.col("b.ord")), "totals": F.array_append("totals", F.col("b.total")),
        }
        state = found.select("question_id", "terms", *(F.when(good, new).otherwise(F.col(c)).alias(c) for c, new in grown.items()))
    return state.select("question_id", "plan", "totals")
