"""Registered queries: scores of hypotheses and plans by beam search, one state for each order and hypotheses from its line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import plans
from factloom.plans.extracted import pick
from factloom.plans.inference import read
from factloom.plans.shared import query

_STEPS, _WIDTH = 3, 4
#: Things, places and verbs of a line item, by its keys.
_THING = lambda key: pick(f"{key} % 4", ["'ann'", "'bob'", "'cat'", "'dog'"])
_HYPOTHESES = f"""SELECT DISTINCT l_orderkey AS state_id, (l_linenumber - 1) % {_STEPS} AS step, 'h' || l_partkey || '-' || l_suppkey AS name, {_THING('l_suppkey')} AS lead, {_THING('l_suppkey')} AS subject,
 {pick('l_partkey % 6', ["'introduced'", "'moves_to'", "'at'", "'meets'", "'calls'", "'meets'"])} AS predicate, CASE WHEN l_partkey % 6 IN (1, 2) THEN {pick('(l_suppkey + l_partkey) % 3', ["'hill'", "'town'", "'dock'"])} WHEN l_partkey % 6 = 0 THEN NULL ELSE {_THING('l_partkey + l_suppkey + 1')} END AS object FROM lineitem"""
_STATES = """SELECT o_orderkey AS state_id, CASE WHEN o_custkey % 5 = 0 THEN array('cat') ELSE array('ann', 'bob') END AS introduced, CASE WHEN o_custkey % 3 = 0 THEN array('town') ELSE array('bob', 'dog') END AS goals,
 CASE WHEN o_custkey % 2 = 0 THEN array(named_struct('thing', 'ann', 'place', 'hill')) ELSE array(named_struct('thing', 'ann', 'place', 'town'), named_struct('thing', 'bob', 'place', 'dock')) END AS places FROM orders"""


def _duck(sql: str) -> str:
    for a, b in (("array(named_struct('thing', 'ann', 'place', 'hill'))", "[{'thing': 'ann', 'place': 'hill'}]"), ("array(named_struct('thing', 'ann', 'place', 'town'), named_struct('thing', 'bob', 'place', 'dock'))", "[{'thing': 'ann', 'place': 'town'}, {'thing': 'bob', 'place': 'dock'}]"), ("array('cat')", "['cat']"), ("array('ann', 'bob')", "['ann', 'bob']"), ("array('town')", "['town']"), ("array('bob', 'dog')", "['bob', 'dog']")):
        sql = sql.replace(a, b)
    return sql


_AT = lambda thing: f"list_filter(places, lambda x: x.thing = {thing})[-1].place"
_BROKEN = {
    "unintroduced_entity": "(NOT list_contains(introduced, subject) AND predicate != 'introduced')",
    "location_change_without_move": f"coalesce(predicate = 'at' AND {_AT('subject')} != object, false)",
    "participants_not_colocated": f"coalesce(predicate NOT IN ('at', 'moves_to', 'introduced') AND {_AT('subject')} != {_AT('object')}, false)",
}
_COUNT = lambda *names: "(" + " + ".join(f"({_BROKEN[n]})::INT" for n in names) + ")"
_TERMS = {
    "causal": "0.5", "temporal": f"-4.0 * {_COUNT('unintroduced_entity')}", "entity": "CASE WHEN list_contains(introduced, lead) OR (predicate = 'introduced' AND subject = lead) THEN 1.0 ELSE -3.0 END",
    "location": f"-4.0 * {_COUNT('location_change_without_move', 'participants_not_colocated')}", "transition": "2.0", "contradiction": f"-6.0 * {_COUNT(*_BROKEN)}",
    "relevance": "CASE WHEN list_contains(goals, subject) OR coalesce(list_contains(goals, object), false) THEN 2.0 ELSE 0.0 END", "repetition": "CASE WHEN list_contains(actions, predicate) THEN -2.0 ELSE 0.0 END",
}
_TOTAL = "(" + " + ".join(f"({t})::DOUBLE" for t in _TERMS.values()) + ")"
_WITH = f"WITH h AS ({_HYPOTHESES}), b0 AS (SELECT *, []::VARCHAR[] AS path, []::VARCHAR[] AS actions, NULL::VARCHAR AS last, 0.0::DOUBLE AS score FROM ({_duck(_STATES)}))"


def _level(k: int) -> str:
    ok = " AND ".join(f"NOT {b}" for b in _BROKEN.values())
    return f"""b{k + 1} AS (SELECT state_id, CASE WHEN predicate = 'introduced' AND NOT list_contains(introduced, subject) THEN list_append(introduced, subject) ELSE introduced END AS introduced, goals,
 CASE WHEN predicate IN ('at', 'moves_to') THEN list_append(list_filter(places, lambda x: x.thing != subject), {{'thing': subject, 'place': object}}) ELSE places END AS places, list_append(path, name) AS path, list_append(actions, predicate) AS actions, lead AS last,
 score + {_TOTAL} + CASE WHEN last = lead THEN 0.5 ELSE 0.0 END AS score FROM b{k} JOIN h USING (state_id) WHERE step = {k} AND {ok} QUALIFY row_number() OVER (PARTITION BY state_id ORDER BY score + {_TOTAL} + CASE WHEN last = lead THEN 0.5 ELSE 0.0 END DESC, list_append(path, name)) <= {_WIDTH})"""


@query(f"{_WITH} SELECT state_id, name, " + ", ".join(f"({t})::DOUBLE AS {n}" for n, t in _TERMS.items()) + f", {_TOTAL} AS total, CASE WHEN {_COUNT(*_BROKEN)} = 0 THEN 'accepted' ELSE 'rejected' END AS status, concat_ws(', ', " + ", ".join(f"CASE WHEN {_BROKEN[n]} THEN '{n}' END" for n in sorted(_BROKEN)) + ") AS rejected FROM b0 JOIN h USING (state_id) WHERE step = 0")
def hypothesis_scores(spark, sf_dir):
    """Every order's first hypotheses with the terms of their scores."""
    return plans.hypothesis_scores(read(spark, sf_dir, _STATES, "orders"), read(spark, sf_dir, _HYPOTHESES, "lineitem"))


@query(f"{_WITH}, {', '.join(_level(k) for k in range(_STEPS))}, e AS (" + " UNION ALL ".join([f"SELECT state_id, path, score, {k} AS blocked_at FROM b{k} WHERE state_id NOT IN (SELECT state_id FROM b{k + 1})" for k in range(_STEPS)] + [f"SELECT state_id, path, score, NULL FROM b{_STEPS}"]) + ") SELECT state_id, array_to_string(path, ' ') AS path, round(score, 6) AS score, len(path)::BIGINT AS n_steps, coalesce(blocked_at, -1)::BIGINT AS blocked_at FROM e QUALIFY row_number() OVER (PARTITION BY state_id ORDER BY e.score DESC, e.path) = 1")
def beam_plans(spark, sf_dir):
    """The best plan of every order; blocked_at is -1 where no step was blocked."""
    found = plans.beam_search(read(spark, sf_dir, _STATES, "orders"), read(spark, sf_dir, _HYPOTHESES, "lineitem"), _STEPS, _WIDTH)
    return found.withColumns({"path": F.array_join("path", " "), "blocked_at": F.coalesce("blocked_at", F.lit(-1).cast("long"))})
