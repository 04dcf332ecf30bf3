"""Operators on the small fixture of facts, event ties, streams and files."""

import random

import pytest

from factloom.functions.normalize import lookup_key
from factloom.functions.policy import hop_reason
from factloom.operators import algebra, events, graph, measures, rules, text
from factloom.sources import files
from factloom.streaming.features import stream_frequencies

G0 = [
    (0, "Ada", "founded", "Northco"), (1, "Ada", "founded", "Southco"), (2, "Bo", "founded", "Eastco"), (3, "Northco", "develops", "engines"),
    (4, "Eastco", "develops", "engines"), (5, "Northco", "is_a", "motor company"), (6, "Eastco", "is_a", "motor company"), (7, "motor company", "is_a", "company"),
    (8, "Southco", "owned_by", "Northco"), (9, "Ada", "leader_of", "Northco", "volatile"), (10, "Southco", "owned_by", "Bo", "stable", "snapshot", ""),
    (11, "Northco", "valued_at", "5", "semi_stable", "snapshot", "2024-01"),
]


@pytest.fixture(scope="module")
def g0(spark):
    full = [(*r, *("stable", "historical", "")[len(r) - 4 :], "low") for r in G0]
    return spark.createDataFrame(full, "ord long, subject string, predicate string, object string, stability string, temporal_class string, as_of string, risk string").cache()


def objects(df, name="object"):
    return sorted(r[name] for r in df.collect())


def test_find_filter_compare_traverse(g0):
    assert objects(algebra.find(g0, "ada", "founded")) == ["Northco", "Southco"]
    assert objects(algebra.find(g0, predicate="develops", object="Engines"), "subject") == ["Eastco", "Northco"]
    second = algebra.filter_secondary(algebra.find(g0, "Ada", "founded"), g0, "develops").collect()
    assert [(r.object, r.secondary_objects) for r in second] == [("Northco", ["engines"])]
    north, east = algebra.find(g0, "Northco"), algebra.find(g0, "Eastco")
    assert objects(algebra.compare(north, east, "intersection")) == ["engines", "motor company"]
    assert objects(algebra.compare(north, east, "difference")) == ["5"]
    size = algebra.compare_size(algebra.find(g0, "Ada", "founded"), algebra.find(g0, "Bo", "founded")).first()
    assert tuple(size) == (2, 1, "a")
    assert [tuple(r) for r in algebra.traverse(g0, "founded", "develops", "Ada").collect()] == [("Ada", "Northco", "engines")]


def test_hop_reasons(g0):
    found = {r.ord: r.reason for r in g0.select("ord", hop_reason().alias("reason")).collect()}
    assert {k: v for k, v in found.items() if v} == {9: "volatile_relation:leader_of", 10: "snapshot_missing_as_of:owned_by"}


def test_plans_audit_when_empty(g0):
    plan = [algebra.Step("find", "a", {"subject": "Ada", "predicate": "founded"}), algebra.Step("count", "n", {"rows": "$a"})]
    decision, out = algebra.execute(plan, g0)
    assert (decision, out.first().n) == ("answer", 2)
    assert algebra.execute([algebra.Step("find", "a", {"subject": "nobody"}), plan[1]], g0) == ("audit", None)


def test_closure_and_paths(g0):
    isa = g0.where("predicate = 'is_a'").select("subject", "object")
    found = {(r.subject, r.object): r.hops for r in graph.closure(isa).collect()}
    assert found[("Northco", "company")] == 2 and ("company", "Northco") not in found
    starts = g0.where("subject = 'Bo'").selectExpr("subject AS start").distinct()
    assert {r.node: r.hops for r in graph.shortest_paths(g0.select("subject", "object"), starts).collect()}["engines"] == 2


def test_rules_and_counterfactual(g0):
    compete = rules.Rule("competitors", (("?a", "develops", "?c"), ("?b", "develops", "?c")), ("?a", "competes_with", "?b"))
    assert {(r.subject, r.object, r.confidence) for r in rules.infer(g0, compete).collect()} == {("Northco", "Eastco", 1.0), ("Eastco", "Northco", 1.0)}
    guarded = rules.Rule("g", compete.body, compete.head, (("?a", "is_a", "motor company"),), 0.4)
    assert rules.infer(g0, guarded).count() == 0
    founders = rules.Rule("f", (("?x", "founded", "?a"), ("?x", "founded", "?b")), ("?a", "share_founder", "?b"))
    assert rules.infer(g0, founders).count() == 2
    assert rules.lost_without(g0, founders, g0.where("ord = 0")).count() == 2
    members = g0.where("predicate = 'is_a'").selectExpr("subject", "object AS class").distinct()
    found = rules.class_implications(members, g0.where("predicate != 'is_a'")).collect()
    assert [(r["class"], r.predicate, r.support, r.population, r.confidence) for r in found] == [("motor company", "develops", 2, 2, 1.0)]


def strict_past(rows):
    out = {}
    for n, (event, us, actor, host, kind) in enumerate(rows):
        past = [r for r in rows[:n] if r[2] == actor and r[4] == kind]
        out[event] = (sum(r[3] == host and us - r[1] <= 24 * events.HOUR for r in past), sum(us - r[1] <= 168 * events.HOUR for r in past))
    return out


def event_rows(seed):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 400) * events.HOUR // 2 for _ in range(150))
    return [(k, t, rng.randrange(3), rng.randrange(2), rng.choice("ab")) for k, t in enumerate(times)]


def test_trailing_counts_with_ties(spark):
    rows = event_rows(1) + [(900, 0, 9, 0, "a"), (901, 24 * events.HOUR, 9, 0, "a"), (902, 48 * events.HOUR + 1, 9, 0, "a")]
    rows.sort(key=lambda r: (r[1], r[0]))
    got = events.frequencies(spark.createDataFrame(rows, "event_id long, us long, actor long, host long, technique string"))
    found = {r.event_id: (r.freq_24h, r.freq_7d) for r in got.collect()}
    assert found == strict_past(rows) and found[901][0] == 1 and found[902][0] == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = event_rows(2)
    schema = "event_id long, us long, actor long, host long, technique string"
    for n in range(3):
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema).coalesce(1).write.json(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))
    query = stream_frequencies(stream).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r.event_id: (r.freq_24h, r.freq_7d) for r in spark.table("counts").collect()} == strict_past(rows)


def test_files(spark, tmp_path):
    item = '{"overlay_type": "overlay_relation", "subject": "A", "predicate": "is_a", "object": "B", "extra": 1}'
    (tmp_path / "items.json").write_text(f"[{item}, {item}]")
    items = files.read_items(spark, str(tmp_path / "items.json"))
    assert items.count() == 2 and files.composed(items, items).count() == 1
    (tmp_path / "log.jsonl").write_text('{"timestamp": "t", "entity": "x"}\n\nbroken\n')
    log = files.read_audit(spark, str(tmp_path / "log.jsonl"))
    assert log.count() == 1
    files.append_audit(log, str(tmp_path / "out"))
    files.append_audit(log, str(tmp_path / "out"))
    assert files.read_audit(spark, str(tmp_path / "out")).count() == 2


def test_text_and_measures(spark):
    docs = spark.createDataFrame([(1, "One two three four"), (2, "one  TWO three, four"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: (r.first_doc, r.is_duplicate) for r in text.duplicates(docs).collect()} == {1: (1, 0), 2: (1, 1), 3: (3, 0), 4: (3, 1)}
    assert {r.ngram: r.n_occurrences for r in text.ngram_counts(docs, 3).collect()} == {"one two three": 2, "two three four": 2}
    assert [r[0] for r in docs.select(text.gate(docs.text)).collect()] == ["too_short", "too_short", "deleted_or_empty", "deleted_or_empty"]
    values = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    assert measures.percentiles(values, "k", "v").first().p50 == 2.5
    keys = spark.createDataFrame([("The U.S. 'Navy'",)], "k string")
    assert keys.select(lookup_key(keys.k)).first()[0] == "us navy"


def test_centroid_margin_abstains(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [0.7, 0.7], 0), (4, [0.0, 0.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    centres = measures.centroids(vectors.where("vec_id < 3"))
    found = {r.vec_id: (r.best_label, r.decision) for r in measures.nearest_centroid(vectors, centres, 0.5, 0.1).collect()}
    assert found[1] == (0, "match") and found[2] == (1, "match") and found[3] == (0, "abstain")


def test_a_rule_added_as_json_fires(spark, tmp_path):
    import json

    data = [
        {"rule_id": "supply", "if_pattern": [{"subject": "?A", "predicate": "buys_from", "object": "?B"}, {"subject": "?B", "predicate": "?P", "object": "?C", "predicate_class": "capability"}],
         "then_pattern": {"subject": "?A", "predicate": "depends_on", "object": "?C"}, "confidence_rule": "constant", "constant_confidence": 0.8},
        {"rule_id": "off", "if_pattern": [{"subject": "?A", "predicate": "buys_from", "object": "?B"}], "then_pattern": {"subject": "?B", "predicate": "sells_to", "object": "?A"}, "enabled": False},
    ]
    (tmp_path / "rules.json").write_text(json.dumps(data))
    found = rules.load_rules(tmp_path / "rules.json")
    assert [r.name for r in found] == ["supply"] and len(rules.BASE_RULES) == 9
    facts = spark.createDataFrame([("Acme", "buys_from", "Bolts Inc", "stable"), ("bolts  inc", "produces", "bolts", "volatile"), ("Other", "produces", "nuts", "stable")], "subject string, predicate string, object string, stability string")
    assert [tuple(r) for r in rules.infer_all(facts, found).collect()] == [("Acme", "depends_on", "bolts", 0.8, "supply")]


def test_most_similar_relation_against_brute_force(spark):
    from factloom.operators import retrieval

    rng = random.Random(3)
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    vectors = [unit([rng.gauss(0, 1) for _ in range(5)]) for _ in range(60)]
    keys = [(f"r{k % 4}", vectors[k]) for k in range(12)]
    out = retrieval.most_similar_relation(spark.createDataFrame(list(enumerate(vectors)), "phrase_id int, v array<double>"), spark.createDataFrame(keys, "relation string, v array<double>"), 0.6, 0.05).collect()
    for r in out:
        best = {}
        for name, v in keys:
            best[name] = max(best.get(name, -2.0), round(sum(a * b for a, b in zip(vectors[r.phrase_id], v, strict=True)), 6))
        top = sorted(best.items(), key=lambda kv: (-kv[1], kv[0]))
        sure = top[0][1] >= 0.6 and top[0][1] - top[1][1] >= 0.05
        assert (r.relation, r.best, r.second) == (top[0][0] if sure else None, pytest.approx(top[0][1]), pytest.approx(top[1][1]))
    assert any(r.relation for r in out) and not all(r.relation for r in out)
