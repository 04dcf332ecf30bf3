"""What must not grow faster than the input: plans that read a table once, hot words, long runs of one key."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.functions import words
from factloom.operators import causal, context, corpus, events, extraction, lookups, pages, retrieval, routing, rules, text, yields
from factloom.plans.registry import QUERIES
from factloom.streaming.features import streamed_frequencies


def test_validation_reads_candidates_once(spark):
    columns = "doc_id long, sent int, pattern_id string, subject string, relation string, object string, confidence string, stability string, risk string, screens string, sentence string"
    triples = [("Ada", "produces", "Oil"), ("Ada", "founded_by", "Bob"), ("Ada", "owned_by", "Cox"), ("Ada", "uses", "Oil"), ("Ada", "is_a", "Lamp"), ("Cox", "uses", "Ada")]
    found = spark.createDataFrame([(k, 0, "p", s, r, o, "high", "stable", "low", "", "s") for k, (s, r, o) in enumerate(triples)], columns)
    surfaces = spark.createDataFrame([(n.lower(), n, "thing") for n in ("Ada", "Oil", "Bob", "Cox", "Lamp")], "surface string, canonical string, type string")
    known = [("ada", "Manufactures", "oil"), ("bob", "founded", "ada"), ("cox", "owns", "ADA"), ("Ada", "uses", "oil"), ("ada", "TYPE_OF", "lamp"), (None, None, None)]
    out = extraction.validated(found, surfaces, spark.createDataFrame(known, "subject string, predicate string, object string"))
    assert {r.doc_id: r.verdict for r in out.collect()} == {0: "duplicate", 1: "duplicate", 2: "conflict", 3: "duplicate", 4: "duplicate", 5: "safe"}
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 4  # candidates, both joins with surfaces, triples


def test_stems_are_parts_of_their_forms():
    assert set(extraction.STEMS) == {p[0] for p in extraction.PATTERNS}
    assert all(extraction.STEMS[name] in pattern.lower() for name, _, pattern, *_ in extraction.PATTERNS)
    # both alternatives of the one form that is a choice of words only
    assert all(extraction.STEMS["leads_active"] in w for w in ("lead", "chair"))


def test_edges_of_equal_words_are_met_once(spark):
    edges = spark.range(4000).selectExpr("id AS edge_id", "CASE WHEN id % 2 = 0 THEN 'Red iron wheel' ELSE 'red wheel of tin' END AS subject", "CASE WHEN id = 7 THEN 'oil lamp' END AS object")
    nodes = spark.createDataFrame([("red wheel",), ("lamp oil red",), ("wheel",), (None,)], "node string")
    met = lookups._shared_words(nodes.withColumn("_nw", lookups._words("node")), edges.select("subject").distinct().withColumn("_sw", lookups._words("subject")))
    assert {(r.node, r.subject): r.k for r in met.collect()} == {("red wheel", "Red iron wheel"): 2, ("red wheel", "red wheel of tin"): 2}
    assert {r.node: r.n_edges for r in lookups.posting_frontier(nodes, edges).collect()} == {"red wheel": 4000, "lamp oil red": 1}


def test_stream_counts_an_actor_in_many_batches(spark, tmp_path):
    rows = spark.range(400).selectExpr("id AS event_id", "timestamp_seconds((id * 7919) % 400 * 900) AS ts", "id % 2 AS user_id", "'view' AS event_type", "1.0D AS value", "'{\"k\": 5}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "16")
    try:
        got = {tuple(r) for r in streamed_frequencies(spark, f"{tmp_path}/events.parquet").collect()}
    finally:
        spark.conf.unset(name)
    want = events.frequencies(events.alerts(spark.read.parquet(f"{tmp_path}/events.parquet"))).select("event_id", "freq_24h", "freq_7d")
    assert got == {tuple(r) for r in want.collect()} and max(r[1] for r in got) > 40


def test_packs_are_grouped_and_ordered_in_one_exchange(spark):
    form = "entity string, subject string, predicate string, object string, stability string"
    relations = spark.createDataFrame([("a", "a", "has", f"b{k}", "stable") for k in range(8)] + [("c", "c", "has", "d", "stable"), ("d", "d", "has", "e", "stable")], form)
    none = spark.createDataFrame([], form)
    weak = spark.createDataFrame([("a", "a", "near", "x", ""), ("c", "c", "near", "d", "")], form)
    out = context.context_packs(spark.createDataFrame([(1, "a"), (2, "c"), (3, "z")], "question_id long, entity string"), none, relations, weak, 8, 24)
    packs = {q: [(r.kind, r.object) for r in sorted(out.collect(), key=lambda r: r.place) if r.question_id == q] for q in (1, 2, 3)}
    assert packs == {1: [("direct", f"b{k}") for k in range(8)], 2: [("direct", "d"), ("one_hop", "e"), ("weak_link", "d")], 3: []}
    assert "hashpartitioning(question_id#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(question_id#\d+L?, subject", plan)


def test_facts_of_pages_are_found_once(spark):
    form = "page long, place long, pattern_id string, subject string, predicate string, object string, risk string, stability string, sentence string"
    facts = spark.createDataFrame([(k, 0, "x", s, "uses", "oil", "low", "stable", "s") for k, s in ((2, "A"), (1, "a"), (1, "A"), (3, "b"))], form)
    out = yields.across_pages(facts)
    assert sorted((r.page, r.subject) for r in out.collect()) == [(1, "A"), (1, "a"), (3, "b")]
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_steps_of_facts_are_not_repeated_in_filters(spark):
    rows = spark.createDataFrame([(1, "Ada", 0, "Ada Works WAS FOUNDED BY Ann Lee.", False)], "page long, title string, place long, sentence string, lead boolean")
    out = yields.yielded(rows)
    assert [(r.subject, r.object) for r in out.collect()] == [("Ada Works", "Ann Lee")]  # words are met in any case, as in SQL
    assert not re.search(r"Filter .*regexp", out._jdf.queryExecution().optimizedPlan().toString())


def test_steps_of_definitions_are_not_repeated_in_filters(spark):
    out = pages.lead_definitions(spark.createDataFrame([(1, "# Ada\n\nAda is a town of note.")], "page long, text string"), "page")
    assert out.first().definition == "town of note"
    assert not re.search(r"Filter .*regexp", out._jdf.queryExecution().optimizedPlan().toString())


def test_trailing_counts_of_a_hot_key_are_differences_of_running_sums(spark):
    rows = spark.range(2000).selectExpr("id AS event_id", "id DIV 2 * 10 AS us", "CASE WHEN id >= 0 THEN 'a' END AS actor")
    out = causal.trailing(rows, ["actor"], 1000, "n")
    assert {r.event_id: r.n for r in out.collect()} == {k: min(k, 200 + k % 2) for k in range(2000)}
    assert not re.search(r"RangeFrame, -", out._jdf.queryExecution().optimizedPlan().toString())


def test_chains_are_grouped_by_triple_only_where_a_subject_has_several_ways(spark):
    rows = [("a", "is_a", "K", "stable"), ("A ", "is_a", "k", "volatile"), ("b", "is_a", "k", "volatile"), ("b", "is_a", "K", "stable"), ("b", "is_a", "l", "semi_stable"), ("k", "uses", "x", "semi_stable"), ("K", "uses", "x", "volatile"), ("k", "uses", "B", "stable"), ("l", "uses", "x", "stable"), ("l", "enables", "y", "odd"), (None, "is_a", "k", "stable"), ("k", "uses", None, "stable")]
    facts = spark.createDataFrame(rows, "subject string, predicate string, object string, stability string")
    rule = next(r for r in rules.BASE_RULES if r.name == "activity_inheritance_v1")
    out = rules.infer(facts, rule)
    got = [(r.subject, r.predicate, r.object, r.confidence) for r in out.collect()]
    assert sorted(got) == sorted([("a", "uses", "x", 0.7), ("a", "uses", "B", 1.0), ("A ", "uses", "x", 0.3), ("A ", "uses", "B", 0.3), ("b", "uses", "x", 0.7), ("b", "enables", "y", 0.5)])
    # the triples of subjects with one way stream from the join
    union = out._jdf.queryExecution().optimizedPlan().toString().split("Union")[1]
    assert union.index("Join") < union.index("Aggregate")
    assert {r.name for r in rules.BASE_RULES if rules._is_chain(r)} == {"capability_inheritance_v1", "activity_inheritance_v1"}


def test_features_are_found_once_before_their_folds(spark, sf_dir, monkeypatch):
    own, leaves = routing.expanding_folds, []

    def folds(rows, *more):
        leaves.append(rows._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return own(rows, *more)

    monkeypatch.setattr(routing, "expanding_folds", folds)
    assert QUERIES["out_of_fold_scores"](spark, sf_dir).count() > 0
    assert leaves == [1]


def test_intents_are_found_once_and_patterns_tried_where_they_stand(spark):
    rows = spark.createDataFrame([("Who FOUNDED it, founded  by whom; head office?",), ("a_head, heads.located where is it#head",), ("headquarters located",), ("",), (None,), ("c3 cx",)], "q string")
    keywords = {"founded by": "founded_by", "founded": "founded", "head office": "headquartered_in", "head": "leader_of", "headquarters": "headquartered_in", "located": "located_in", "where is": "located_in", "c[0-9]": "coded"}
    out = rows.select("q", words.intents(F.col("q"), keywords).alias("r"))
    assert [r.r for r in out.collect()] == [["founded", "founded_by", "headquartered_in"], ["leader_of", "located_in"], ["headquartered_in"], [], [], ["coded"]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"aggregate\(", plan)) == 1 and "contains(" in plan.lower()


def test_phrases_of_a_question_meet_once(spark):
    phrases = spark.createDataFrame([("head", "leader_of"), ("head office", "in"), ("head office", "at"), ("office of", "seat"), ("of", "part_of"), ("of", None), (None, "x")], "phrase string, predicate string")
    questions = spark.createDataFrame([(1, "Head office of head, head"), (2, "of  OF"), (3, ""), (4, None), (5, "a office of")], "question_id long, question string")
    out = retrieval.phrase_predicates(questions, phrases)
    assert sorted((r.question_id, r.predicate or "", r.place) for r in out.collect()) == [(1, "", 2), (1, "at", 0), (1, "in", 0), (1, "leader_of", 3), (1, "part_of", 2), (2, "", 0), (2, "part_of", 0), (5, "seat", 1)]
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 3 and "posexplode" not in plan.toString()  # questions, phrases and their first words


def test_grams_and_pairs_are_counted_in_blocks(monkeypatch):
    texts = ["A b a-B a", None, "", "a\nb a", "b b b c", "é A,B"]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"]) for part in (texts[:3], texts[3:], [])]
    want = {"a b": (3, 2), "b a": (3, 2), "b b": (2, 1), "b c": (1, 1)}
    # within a line: places 1 and 2 apart
    pairs = {("a", "b"): 6, ("b", "c"): 2}
    for size in (1 << 20, 1, 4):
        monkeypatch.setattr(text, "_BLOCK", size)
        got, met = {}, {}
        for block in text._gram_counts(2)(iter(batches)):
            for g, n, d in zip(*(c.to_pylist() for c in block.columns), strict=True):
                got[g] = (got.get(g, (0, 0))[0] + n, got.get(g, (0, 0))[1] + d)
        for block in text._pair_counts(2)(iter(batches)):
            for a, b, n in zip(*(c.to_pylist() for c in block.columns), strict=True):
                met[a, b] = met.get((a, b), 0) + n
        assert got == {"a b": (4, 3), **{k: want[k] for k in want if k != "a b"}} and met == pairs
    monkeypatch.setattr(text, "_BLOCK", 1 << 20)
    assert [sorted(b.column(0).to_pylist()) for b in text._gram_counts(4)(iter(batches))] == [["a b a b", "b a b a", "b b b c"]]


def test_texts_are_split_once_for_their_grams(spark):
    docs = spark.createDataFrame([(1, "One two, three one two"), (2, "two"), (3, None)], "doc_id long, text string")
    own = docs.select("doc_id", *(text.ngrams(F.col("text"), n).alias(f"g{n}") for n in (1, 2, 3)))
    assert [tuple(r)[1:] for r in own.orderBy("doc_id").collect()] == [(["one", "two", "three", "one", "two"], ["one two", "two three", "three one", "one two"], ["one two three", "two three one", "three one two"]), (["two"], [], []), ([], [], [])]
    plan = text.overlap(docs, docs, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # documents and benchmark, once each
    pairs = spark.createDataFrame([("one", "two"), ("two", "one"), ("x", None)], "a string, b string")
    out = corpus.link_scores(docs, pairs)
    assert sorted(tuple(r) for r in out.collect()) == [("one", "two", 8), ("two", "one", 1)]
    assert "regexp_replace" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "mapInArrow" not in plan.replace("MapInArrow", "mapInArrow")


def test_hits_of_questions_are_dealt_before_they_are_counted(spark):
    events = spark.createDataFrame([("caution", "topic one", "hedge_claim", 2, "low"), ("caution", "topic two", "hedge_claim", 5, "high")], "kind string, topic string, pattern string, signal_count long, confidence string")
    questions = spark.createDataFrame([(1, "Topic two, hedge"), (2, "none")], "question_id long, question string")
    out = retrieval.pattern_search(events, questions)
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [(1, 1, "caution", "topic two", "hedge_claim", 56.0), (1, 2, "caution", "topic one", "hedge_claim", 28.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(question_id" in plan and not re.search(r"hashpartitioning\(question_id#\d+L?, kind", plan)
