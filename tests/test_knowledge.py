"""Answer plans, gates and corpus operators on small cases: nulls, ties, empty tables, clashing columns."""

import random

from factloom.operators import corpus, evidence, gates

FACTS = "ord long, subject string, predicate string, object string, stability string, risk string"


def fact(number, subject, predicate, object, stability="stable", risk="low"):
    return number, subject, predicate, object, stability, risk


def plans(spark, facts, questions):
    asked = spark.createDataFrame(questions, "question_id long, target string, text string")
    return {r.question_id: r.plan for r in evidence.answer_plans(spark.createDataFrame(facts, FACTS), asked).collect()}


def test_answer_plan_walks_from_the_target_and_stops(spark):
    facts = [
        fact(0, "Ada", "founded", "Northco"),
        fact(1, "Northco", "develops", "steam engines"),
        fact(2, "Northco", "develops", "steam engines"),
        fact(3, "Bo", "founded", "Ada"),
        fact(4, None, "founded", "Ada"),
        fact(5, "Ada", None, "Northco"),
    ]
    got = plans(spark, facts, [(1, "Ada", "what has Ada founded"), (2, None, "what"), (3, "nobody", "nobody"), (4, "Ada", "unrelated words")])
    # The second develops fact adds no word; without a shared word, or a target, there is no first step.
    assert got == {1: [0, 1], 2: [], 3: [], 4: []}


def test_answer_plan_prefers_the_relevant_then_the_smaller_ord(spark):
    facts = [fact(7, "Ada", "likes", "chess"), fact(5, "Ada", "likes", "music"), fact(9, "Ada", "founded", "Northco", "volatile", "high")]
    got = plans(spark, facts, [(1, "Ada", "Ada likes chess"), (2, "Ada", "Ada likes")])
    assert got[1][0] == 7 and got[2][0] == 5


def test_answer_plans_of_no_questions(spark):
    assert plans(spark, [fact(0, "a", "b", "c")], []) == {}
    assert plans(spark, [], [(1, "Ada", "Ada")]) == {1: []}


def test_gates_take_the_first_defect(spark):
    facts = [
        fact(0, "Ada", "is", "ada"), fact(1, "It", "is", "x"), fact(2, None, "is", "x"), fact(3, "Bo", "is", "x", "volatile"),
        fact(4, "Bo", "is_a", "Thing"), fact(5, "Bo", "is_a", "pump", "stable", "high"), fact(6, "Bo", "is_a", "pump", None), fact(7, "Bo", "is_a", "pump"),
    ]
    rows = spark.createDataFrame(facts, FACTS).select("ord", gates.chained(gates.delta_verdict(), gates.admission()).alias("g")).collect()
    assert {r.ord: (r.g.gate, r.g.reason) for r in rows} == {
        0: (1, "self_relation"), 1: (1, "generic_subject"), 2: (1, "generic_subject"), 3: (1, "volatile_evidence"),
        4: (1, "is_a_object_too_broad"), 5: (2, "volatile_or_high_risk"), 6: (2, "relation_stability_not_safe"), 7: (2, "none"),
    }


def test_screens_split_sentences_and_keep_empty_documents(spark):
    rows = spark.createDataFrame([(1, "It is not so. It isn't! Fine.\nToday, in 2024."), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in gates.screened(rows).collect()}
    assert (got[1].n_sentences, got[1].n_negation, got[1].n_live, got[1].n_volatile_year, got[1].n_safe) == (4, 2, 1, 0, 1)
    assert got[2].n_sentences == got[3].n_sentences == got[2].n_safe == 0


def test_readiness_lists_all_reasons(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "u", "<title>a</title>" + "x" * 500)], "page_id long, url string, html string")
    got = {r.page_id: (r.ready, r.reasons) for r in gates.readiness(rows).collect()}
    assert got == {1: (0, "raw_text_missing_or_short|source_url_missing|title_missing"), 2: (1, "")}


def test_spans_are_leftmost_longest_as_by_brute_force(spark):
    dice = random.Random(5)
    texts = [(k, " ".join(dice.choice("abc") for _ in range(dice.randint(0, 30)))) for k in range(30)] + [(99, None)]
    known = ["a b", "b", "b c a", "c c", "b"]
    want = set()
    for doc, text in texts:
        words, at = (text or "").split(), 0
        while at < len(words):
            fits = [n for n in (3, 2, 1) if at + n <= len(words) and " ".join(words[at : at + n]) in known]
            if fits:
                want.add((doc, at, fits[0], " ".join(words[at : at + fits[0]])))
            at += fits[0] if fits else 1
    got = corpus.spans(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(s,) for s in known + [None]], "surface string"))
    assert {tuple(r) for r in got.collect()} == want


def test_votes_break_ties_and_leave_nulls_out(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (None, "a"), (2, "x"), (2, "x"), (2, "y")], "key long, label string")
    assert {tuple(r) for r in corpus.vote(rows, "key", "label").collect()} == {(1, "a", 1, 2, 0), (2, "x", 2, 3, 1)}


def test_single_meaning_needs_support(spark):
    rows = spark.createDataFrame([("f", "p"), ("f", "p"), ("g", "p"), ("h", "p"), ("h", "q"), ("i", None)], "frame string, predicate string")
    assert [tuple(r) for r in corpus.single_meaning(rows, "frame", "predicate").collect()] == [("f", "p", 2)]


def test_layers_compose_first_wins(spark):
    layer = lambda rows: spark.createDataFrame(rows, "name string, ord long")
    got = corpus.composed(layer([("a", 5), ("a", 4), (None, 1)]), layer([("a", 0), ("b", 2), (None, 0)]))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 4), (None, 1, 1), ("b", 2, 2)}


def test_texts_rebuild_from_postings(spark):
    rows = spark.createDataFrame([(1, "x", [0, 2]), (1, "y", [1]), (2, "z", [])], "k long, word string, positions array<int>")
    assert [tuple(r) for r in corpus.rebuilt(rows, "k").collect()] == [(1, "x y x")]


def test_window_keeps_each_entity_at_its_newest_turn(spark):
    a, b, c = "a" * 12, "b" * 12, "c" * 12
    turns = [(1, 0, "user", c), (1, 1, "user", f"{a} {b}"), (1, 2, "assistant", None), (1, 3, "user", f"{b}"), (1, 4, "user", "short")]
    got = corpus.entities_in_window(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert [tuple(r) for r in got.collect()] == [(1, f"{a} {b}")]
