"""Beam search against enumeration with the same beam, and with a beam wide enough against all plans."""

import itertools
import random

import pytest

from factloom.operators import plans

STATES = "state_id long, introduced array<string>, goals array<string>, places array<struct<thing:string,place:string>>"
HYPOTHESES = "state_id long, step int, name string, lead string, subject string, predicate string, object string"


def step(state, h, actions, last):
    introduced, places = state
    _, lead, subject, predicate, object_ = h[2:]
    here, there = places.get(subject), places.get(object_)
    if subject not in introduced and predicate != "introduced":
        return None
    if predicate == "at" and here is not None and here != object_:
        return None
    if predicate not in ("at", "moves_to", "introduced") and here is not None and there is not None and here != there:
        return None
    score = 2.5 + (1 if lead in introduced or (predicate == "introduced" and subject == lead) else -3) - 2 * (predicate in actions) + 0.5 * (last == lead)
    new = (introduced | {subject} if predicate == "introduced" else introduced, places | {subject: object_} if predicate in ("at", "moves_to") else places)
    return new, score


def brute(states, hypotheses, steps, width):
    out = []
    for key, introduced, goals, places in states:
        beam, blocked = [(0.0, [], (frozenset(introduced), {p["thing"]: p["place"] for p in places}), [], None)], None
        for k in range(steps):
            grown = []
            for (score, path, state, actions, last), h in itertools.product(beam, [h for h in hypotheses if h[0] == key and h[1] == k]):
                found = step(state, h, actions, last)
                if found:
                    relevant = 2 * (h[4] in goals or h[6] in goals)
                    grown.append((score + found[1] + relevant, [*path, h[2]], found[0], [*actions, h[5]], h[3]))
            if not grown:
                blocked = k
                break
            beam = sorted(grown, key=lambda x: (-x[0], x[1]))[:width]
        best = min(beam, key=lambda x: (-x[0], x[1]))
        out.append((key, best[1], round(best[0], 6), len(best[1]), blocked))
    return sorted(out)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_beam_equals_enumeration(spark, width):
    rng = random.Random(width)
    things, spots = ["ann", "bob", "cat"], ["hill", "town"]
    states = [(k, rng.sample(things, rng.randrange(3)), rng.sample(things + spots, 2), [{"thing": t, "place": rng.choice(spots)} for t in rng.sample(things, rng.randrange(3))]) for k in range(25)]
    hypotheses = []
    for k, s in itertools.product(range(25), range(3)):
        for n in range(rng.randrange(5)):
            verb = rng.choice(["introduced", "moves_to", "at", "meets", "calls"])
            hypotheses.append((k, s, f"n{n}", rng.choice(things), rng.choice(things), verb, rng.choice(spots) if verb in ("moves_to", "at") else None if verb == "introduced" else rng.choice(things)))
    found = plans.beam_search(spark.createDataFrame(states, STATES), spark.createDataFrame(hypotheses, HYPOTHESES), 3, width)
    assert sorted(map(tuple, found.collect())) == brute(states, hypotheses, 3, width)


def test_terms_can_be_disabled_and_empty_lattices(spark):
    states = spark.createDataFrame([(1, ["ann"], ["hill"], [])], STATES)
    hypotheses = spark.createDataFrame([(1, 0, "go", "ann", "ann", "moves_to", "hill"), (1, 0, "who", "bob", "bob", "meets", "ann")], HYPOTHESES)
    got = {r.name: r for r in plans.hypothesis_scores(states, hypotheses).collect()}
    assert (got["go"].total, got["go"].status) == (5.5, "accepted")
    assert (got["who"].total, got["who"].rejected) == (0.5 - 4 - 3 + 2 - 6, "unintroduced_entity")
    assert {r.name: r.total for r in plans.hypothesis_scores(states, hypotheses, ("relevance", "contradiction")).collect()} == {"go": 3.5, "who": -4.5}
    assert [tuple(r) for r in plans.beam_search(states, hypotheses.where("false"), 2).collect()] == [(1, [], 0.0, 0, 0)]
    assert plans.beam_search(states.where("false"), hypotheses, 2).count() == 0
