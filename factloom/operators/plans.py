"""Plans of steps by beam search over a lattice of hypotheses, for all starting states at once.

A hypothesis asserts one fact (subject, predicate, object) and is accepted if it breaks no rule of the state: its subject must
be introduced, nothing is at two places, and what acts on something is where that is. Each level joins every state's beam
with the next step's hypotheses and keeps the best few of each state, in a total order; Spark cuts each state's rows
to them before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.lineage import cut

# The weights of a hypothesis's terms and of going on with the same leading thing.
WEIGHTS = {"causal": 0.5, "temporal": -4.0, "entity": 1.0, "entity_unknown": -3.0, "location": -4.0, "transition": 2.0, "contradiction": -6.0, "relevance": 2.0, "repetition": -2.0}
CONTINUITY = 0.5
TERMS = ("causal", "temporal", "entity", "location", "transition", "contradiction", "relevance", "repetition")
_PLACES = "array<struct<thing:string,place:string>>"


def _place(thing: Column) -> Column:
    """Where the state has a thing, or null."""
    return F.try_element_at(F.filter("places", lambda x: x["thing"] == thing), F.lit(-1))["place"]


def violations() -> dict[str, Column]:
    """For each rule whether the row's hypothesis breaks it in the row's state."""
    known = F.array_contains("introduced", F.col("subject"))
    here, there = _place(F.col("subject")), _place(F.col("object"))
    predicate = F.col("predicate")
    return {
        "unintroduced_entity": ~known & (predicate != "introduced"),
        "location_change_without_move": F.coalesce((predicate == "at") & (here != F.col("object")), F.lit(False)),
        "participants_not_colocated": F.coalesce(~predicate.isin("at", "moves_to", "introduced") & (here != there), F.lit(False)),
    }


def terms(disabled: tuple[str, ...] = ()) -> dict[str, Column]:
    """The named terms of a hypothesis's score in the row's state; ``disabled`` ones are 0."""
    broken = violations()
    count = lambda *names: reduce(lambda a, b: a + b, (broken[n].cast("int") for n in names))
    introduced = F.array_contains("introduced", F.col("lead")) | ((F.col("predicate") == "introduced") & (F.col("subject") == F.col("lead")))
    relevant = F.array_contains("goals", F.col("subject")) | F.coalesce(F.array_contains("goals", F.col("object")), F.lit(False))
    found = {
        "causal": F.lit(WEIGHTS["causal"]),
        "temporal": WEIGHTS["temporal"] * count("unintroduced_entity"),
        "entity": F.when(introduced, WEIGHTS["entity"]).otherwise(WEIGHTS["entity_unknown"]),
        "location": WEIGHTS["location"] * count("location_change_without_move", "participants_not_colocated"),
        "transition": F.lit(WEIGHTS["transition"]),
        "contradiction": WEIGHTS["contradiction"] * count(*broken),
        "relevance": F.when(relevant, WEIGHTS["relevance"]).otherwise(0.0),
        "repetition": F.when(F.array_contains("actions", F.col("predicate")), WEIGHTS["repetition"]).otherwise(0.0),
    }
    return {name: F.lit(0.0) if name in disabled else found[name] + F.lit(0.0) for name in TERMS}


def _started(states: DataFrame) -> DataFrame:
    return states.withColumns({"path": F.array().cast("array<string>"), "actions": F.array().cast("array<string>"), "last": F.lit(None).cast("string"), "score": F.lit(0.0)})


def hypothesis_scores(states: DataFrame, hypotheses: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(state_id, name, terms, total, status, rejected): each first-step hypothesis in its starting state."""
    rows = _started(states).join(hypotheses.where("step = 0").drop("step"), "state_id")
    parts, broken = terms(disabled), violations()
    total = reduce(lambda a, b: a + b, parts.values())
    reasons = F.array_join(F.array_sort(F.array_compact(F.array(*(F.when(c, n) for n, c in broken.items())))), ", ")
    return rows.select("state_id", "name", *(c.alias(n) for n, c in parts.items()), total.alias("total"), F.when(reasons == "", "accepted").otherwise("rejected").alias("status"), reasons.alias("rejected"))


def beam_search(states: DataFrame, hypotheses: DataFrame, steps: int, width: int = 4, disabled: tuple[str, ...] = ()) -> DataFrame:
    """(state_id, path, score, n_steps, blocked_at): the best plan of each state.

    ``states`` has state_id, introduced, goals (arrays) and places (things with places); ``hypotheses`` state_id, step, name, lead, subject, predicate
    and object; names are distinct in a step of a state. A state that no hypothesis of a step continues stops before it. Equal scores
    are ordered by the names on the path.
    """
    best = Window.partitionBy("state_id").orderBy(F.desc("score"), "path")
    beam, ended = _started(states), None
    broken = reduce(lambda a, b: a | b, violations().values())
    for step in range(steps):
        own = hypotheses.where(F.col("step") == step).drop("step")
        rows = beam.join(own, "state_id").where(~broken)
        gained = reduce(lambda a, b: a + b, terms(disabled).values()) + F.when(F.col("last") == F.col("lead"), CONTINUITY).otherwise(0.0)
        moved = F.when(F.col("predicate").isin("at", "moves_to"), F.concat(F.filter("places", lambda x: x["thing"] != F.col("subject")), F.array(F.struct(F.col("subject").alias("thing"), F.col("object").alias("place"))).cast(_PLACES))).otherwise(F.col("places"))
        known = F.when(F.col("predicate") == "introduced", F.array_union("introduced", F.array("subject"))).otherwise(F.col("introduced"))
        rows = rows.select("state_id", known.alias("introduced"), "goals", moved.alias("places"), F.array_append("path", F.col("name")).alias("path"), F.array_append("actions", F.col("predicate")).alias("actions"), F.col("lead").alias("last"), (F.col("score") + gained).alias("score"))
        rows = cut(rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= width))
        # states without a continuation stop with the best of their beam
        stopped = beam.join(rows.select("state_id").distinct(), "state_id", "left_anti").withColumn("blocked_at", F.lit(step))
        ended = stopped if ended is None else ended.unionByName(stopped, allowMissingColumns=True)
        beam = rows
    done = beam.withColumn("blocked_at", F.lit(None).cast("int"))
    found = done if ended is None else done.unionByName(ended, allowMissingColumns=True)
    found = found.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return found.select("state_id", "path", F.round("score", 6).alias("score"), F.size("path").cast("long").alias("n_steps"), F.col("blocked_at").cast("long").alias("blocked_at"))
