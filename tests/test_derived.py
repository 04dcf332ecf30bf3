"""Joins, base rules, routing, activation and folds on small fixtures and against brute force."""

import random
from collections import defaultdict

import pytest

from factloom.operators import activation, joins, routing, rules
from factloom.streaming import folds

FACTS = "ord long, subject string, predicate string, object string, stability string, risk string, temporal_class string, as_of string"


def facts_of(spark, rows):
    return spark.createDataFrame([(k, *r[:3], r[3] if len(r) > 3 else "stable", "low", "historical", "") for k, r in enumerate(rows)], FACTS)


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_base_rules(spark):
    own = facts_of(spark, [
        ("Tube", "owned_by", "Alpha"), ("Alpha", "develops", "maps"), ("Alpha", "owned_by", "Holding"), ("Lab", "owned_by", "Alpha"), ("Lab", "subsidiary_of", "Alpha"),
        ("Beta", "publishes", "maps", "volatile"), ("Tube", "founded_by", "Ann"), ("Beta", "founded_by", "Ann"), ("Ann", "known_for", "maps"), ("rain", "enables", "crops"), ("crops", "requires", "soil"),
        ("fern", "is_a", "plant"), ("plant", "uses", "light"), ("plant", "is_a", "life"),
    ])
    types = spark.createDataFrame([("tube", "service"), ("Alpha", "organization"), ("Beta", "organization"), ("Lab", "organization"), ("Ann", "person")], "entity string, type string")
    found = defaultdict(set)
    for r in rules.infer_all(own, types=types).collect():
        found[r.rule].add((r.subject, r.predicate, r.object))
    assert found["capability_inheritance_v1"] == {("Tube", "develops", "maps")}
    assert found["ownership_transitivity_v1"] == {("Tube", "owned_by", "Holding"), ("Lab", "owned_by", "Holding")}
    assert found["founder_shared_v1"] == {("Tube", "share_founder", "Beta"), ("Beta", "share_founder", "Tube")}
    assert found["competitor_detection_v1"] == {("Alpha", "competes_with", "Beta"), ("Beta", "competes_with", "Alpha")}
    assert found["causal_chain_v1"] == {("rain", "indirectly_requires", "soil")}
    assert found["activity_inheritance_v1"] == {("fern", "uses", "light")} and found["classification_chain_v1"] == {("fern", "is_a", "life")}
    assert found["expertise_inheritance_v1"] == {("Tube", "associated_with_expertise", "maps"), ("Beta", "associated_with_expertise", "maps")}
    with pytest.raises(ValueError):
        rules.infer(own, rules.BASE_RULES[0])


def test_resolution_takes_the_first_hit(spark):
    known = spark.createDataFrame([(0, 10, "Mercury", ["the planet"], "Mercury (planet)"), (1, 11, "Mercury", [], None), (2, 12, "Hg", ["Mercury", "quick.silver"], "Element"), (3, 13, None, None, "Element")], "ord long, entity_id long, label string, aliases array<string>, page string")
    asked = spark.createDataFrame([("Mercury",), ("mercury",), ("Planet",), ("QUICKSILVER",), ("element",), ("none",), (None,), ("Mercury",)], "surface string")
    assert got(joins.resolve(asked, known), "surface", "entity_id", "how") == sorted([("Mercury", 10, 1), ("mercury", 10, 3), ("Planet", 10, 4), ("QUICKSILVER", 12, 4), ("element", 12, 5)], key=repr)
    assert joins.resolve(asked.where("false"), known).count() == 0


def test_connections_block_on_the_first_path(spark):
    own = facts_of(spark, [("A", "p", "B", "volatile"), ("A", "p", "D"), ("B", "q", "C"), ("D", "q", "C"), ("E", "p", "D")])
    pairs = spark.createDataFrame([("A", "C"), ("C", "E"), ("A", "E")], "a string, c string")
    assert got(joins.connections(own, pairs), "a", "c", "direction", "status", "via") == sorted([("A", "C", "forward", "blocked", "B"), ("C", "E", "reverse", "answer", "D"), ("A", "E", None, "audit", None)], key=repr)


def test_bridges(spark):
    own = facts_of(spark, [("A", "uses", "M"), ("A", "founded", "N"), ("C", "p", "M"), ("N", "p", "C"), ("A", "p", "B"), ("X", "p", "Y")])
    pairs = spark.createDataFrame([("A", "C"), ("B", "A"), ("A", "X")], "subject string, object string")
    assert got(joins.bridges(own, pairs, {"founded": 0}), "subject", "object", "status", "bridge") == [("A", "C", "speculative", "N"), ("A", "X", "audit", None), ("B", "A", "direct", None)]
    assert got(joins.bridges(own, pairs), "bridge")[0] == ("M",)


def test_deltas_and_context(spark):
    base = facts_of(spark, [("x", "founded", "Y")])
    new = facts_of(spark, [("Y", "founded_by", "X"), ("X", "founded", "y"), ("x", "founded", "z"), ("X", "founded", "Z")])
    assert got(joins.new_items(new, base, {"founded": "founded_by"}), "ord", "object") == [(2, "z")]
    items = spark.createDataFrame([("s", "a", "p", "1"), ("s", "b", "p", "9"), ("s", "c", "p", "3"), ("t", "b", "p", "2"), ("t", "d", "p", "4")], "source string, subject string, predicate string, object string")
    known = spark.createDataFrame([("a", "p", "1"), ("b", "p", "2")], "subject string, predicate string, object string")
    assert got(joins.classified_delta(items, known), "source", "subject", "status") == [("s", "a", "tainted"), ("s", "b", "conflict"), ("s", "c", "tainted"), ("t", "b", "duplicate"), ("t", "d", "new")]
    near = facts_of(spark, [("M", "p", "A"), ("A", "p", "B"), ("B", "p", "C"), ("D", "p", "M"), ("D", "p", "A")])
    assert got(joins.one_hop(near, spark.createDataFrame([("M",)], "entity string")), "subject", "object") == [("A", "B"), ("D", "A")]


def test_activation_is_the_largest_of_what_arrives(spark):
    nodes = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.5)], "node string, value double")
    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a",), ("a",)], "node string")
    value = {r.node: r.value for r in activation.activate(nodes, edges, seeds).collect()}
    assert value == pytest.approx({"a": 3.5, "b": 3.5 * 0.75 * 0.35, "c": 0.5})
    near = {r.node: r.value for r in activation.activate_near(nodes, edges, seeds).collect()}
    assert near == pytest.approx({"a": 4.0, "b": 4 * 0.75 * 0.45, "c": 4 * 0.75 * 0.45 * 0.5 * 0.45})


def test_ranking_metrics_and_scores(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.0, 0.2, 0.25, 0.2501, 0.9, 1.0]), rng.randint(0, 1)) for _ in range(60)]
    out = routing.ranking_metrics(spark.createDataFrame([*rows, (None, 1), (0.5, None)], "score double, label int"), 8).first()
    good, bad = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    mean = sum(sum(g2 >= g for g2 in good) / sum(s >= g for s, _ in rows) for g in good) / len(good)
    assert (out.n, out.positives) == (60, len(good)) and out.roc_auc == pytest.approx(auc, abs=1e-6) and out.average_precision == pytest.approx(mean, abs=1e-6)
    empty = routing.ranking_metrics(spark.createDataFrame([], "score double, label int")).first()
    assert tuple(empty) == (0, 0, None, None)
    line = spark.createDataFrame([(float(k), int(k >= 10)) for k in range(20)], "x double, label int")
    assert routing.ranking_metrics(routing.logistic_scores(line, line, ["x"])).first().roc_auc == 1.0
    assert routing.logistic_scores(line.where("label = 1"), line, ["x"]).first().score == 1.0


def test_limiter_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.randint(0, 40) * 500_000, k) for k in range(150)]
    found = {r.event_id: (r.admitted, r.retry_after) for r in folds.limited(spark.createDataFrame(rows, "key long, us long, event_id long"), 2, 4).collect()}
    kept, want = defaultdict(list), {}
    for key, us, event in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        live = [t for t in kept[key] if t > us - 4_000_000]
        want[event] = (0, max(1, int((4_000_000 - (us - live[0])) / 1e6) + 1)) if len(live) >= 2 else (1, 0)
        if want[event][0]:
            kept[key].append(us)
    assert found == want


def test_dialogue_state_evicts_idle_and_least_recent(spark):
    turns = [(1, 0, True, ["a", "b"]), (1, 1, False, ["z"]), (1, 2, True, ["c"]), (1, 3, True, []), (1, 4, True, ["d", "a"]), (2, 0, False, ["q"])]
    df = spark.createDataFrame(turns, "conv_id long, turn long, confirmed boolean, entities array<string>")
    out = got(folds.dialogue_states(df, idle=2, most=2), "conv_id", "turn", "n_active", "evicted", "topic")
    assert out == [(1, 0, 2, 0, "a"), (1, 1, 2, 0, "a"), (1, 2, 2, 1, "c"), (1, 3, 2, 0, "c"), (1, 4, 2, 1, "d"), (2, 0, 0, 0, "")]
