"""Parsed records, dialogue, definitions, membership, picks and multi-technique features on small cases."""

import json
from hashlib import sha256

from factloom.operators import dialogue, events, joins
from factloom.sources import records


def test_works_need_all_fields_and_order_words(spark):
    good = {"id": "1", "title": "T", "url": "u", "abstract_index": {"b": [1], "a": [0, 2]}}
    payloads = [(1, json.dumps(good)), (2, json.dumps({**good, "title": ""})), (3, json.dumps({**good, "abstract_index": None})), (4, "{bad"), (5, None)]
    got = records.works(spark.createDataFrame(payloads, "id long, payload string")).collect()
    assert [(r.id, r.abstract) for r in got] == [("1", "a b a")]


def test_hits_name_the_actor_in_tiers(spark):
    hit = lambda user, source, host: json.dumps({"timestamp": "2024-01-01T00:00:01Z", "agent": {"name": host}, "data": {"user": user, "srcuser": source}})
    rows = [(1, hit("u", "s", "h")), (2, hit(" ", "s", "h")), (3, hit(None, None, "h")), (4, hit(None, None, None)), (5, "not json"), (6, None)]
    got = {r.n: (r.actor, r.tier, r.missing_subject, r.host_fallback) for r in records.hits(spark.createDataFrame(rows, "n long, payload string")).collect()}
    assert got == {1: ("u", 1, 0, 0), 2: ("s", 2, 1, 0), 3: ("h", 3, 1, 1), 4: (None, 4, 1, 0), 5: (None, 4, 1, 0), 6: (None, 4, 1, 0)}


def test_entries_of_bad_xml_have_no_row(spark):
    rows = [(1, "<entry><id>a</id><title>T</title><author><name>X</name></author><author><name>Y</name></author></entry>"), (2, "<entry><id>b</id></entry>"), (3, "<entry"), (4, None), (5, "<entry><id>c</id><title>U</title></entry>")]
    got = {r.n: (r.id, r.title, r.authors) for r in records.entries(spark.createDataFrame(rows, "n long, payload string")).collect()}
    assert got == {1: ("a", "T", ["X", "Y"]), 5: ("c", "U", [])}


def test_definitions_rank_label_page_alias(spark):
    known = spark.createDataFrame([(3, "Ada", "late", "Q"), (1, "the ada", "by label", "Q"), (0, "Countess", "by alias", "Q"), (2, "Bo", "by page", "P"), (4, None, "x", None)], "ord long, subject string, definition string, page string")
    own = spark.createDataFrame([(1, "Ada", ["Countess"], "P"), (2, "no", ["Countess"], "P"), (3, None, ["Countess"], None), (4, None, None, None)], "entity_id long, label string, aliases array<string>, page string")
    assert {tuple(r) for r in joins.definitions(own, known).collect()} == {(1, "by label", 100), (2, "by page", 80), (3, "by alias", 10)}


def test_membership_says_no_only_by_contradiction(spark):
    pairs = lambda rows, names: spark.createDataFrame(rows, names)
    direct = pairs([("a", "cat"), ("b", "unknown")], "subject string, object string")
    reach = pairs([("a", "cat"), ("a", "animal"), ("b", "unknown")], "subject string, object string")
    groups = pairs([("cat", "living"), ("animal", "living"), ("rock", "dead")], "class string, `group` string")
    asked = pairs([("a", "animal"), ("a", "rock"), ("b", "rock"), ("c", "cat"), ("a", "animal")], "subject string, class string")
    got = {tuple(r) for r in joins.membership(asked, reach, direct, groups).collect()}
    assert got == {("a", "animal", "yes"), ("a", "rock", "no"), ("b", "rock", "audit"), ("c", "cat", "audit")}


def test_one_to_one_states_each_key(spark):
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "id long")
    got = {tuple(r) for r in joins.one_to_one(keys([1, 2, 3, 3, None]), keys([1, 3, 4]), "id").collect()}
    assert got == {(1, "matched"), (2, "missing"), (3, "repeated"), (4, "extra")}


def test_weighted_pick_follows_the_hash(spark):
    options = [("x", "a", 5), ("x", "b", 3), ("x", "c", 3), ("y", "only", 1), ("z", "none", 0)]
    got = {tuple(r) for r in joins.weighted_pick(spark.createDataFrame(options, "src string, dst string, weight long"), "s").collect()}
    drawn = int(sha256(b"s:x").hexdigest()[:12], 16) % 11
    assert got == {("x", "a" if drawn < 5 else "b" if drawn < 8 else "c"), ("y", "only")}


def test_salience_and_reference(spark):
    turns = [(1, 0, "user", "ada bo"), (1, 1, "assistant", "ada"), (1, 2, "user", "ada ada"), (2, 0, "assistant", "bo ada"), (3, 0, "user", None)]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    scored = dialogue.activations(rows, F.split("text", " ")).withColumn("salience", dialogue.salience())
    assert {(r.conv_id, r.entity): r.salience for r in scored.collect()} == {(1, "ada"): 40 + 30 + 15 + 12, (1, "bo"): 15 - 24 + 3, (2, "ada"): 43, (2, "bo"): 43}
    got = {tuple(r) for r in dialogue.singular(scored).collect()}
    assert got == {(1, "ada", 97, "resolved"), (2, "ada", 43, "ambiguous")}


def test_multi_technique_takes_least_count_and_any_novelty(spark):
    rows = [(1, 0, "u", ["a", "a"]), (2, 5, "u", ["a", "b"]), (3, 9, "u", ["a"]), (4, 9, "v", None)]
    got = {tuple(r) for r in events.multi_technique(spark.createDataFrame(rows, "event_id long, us long, actor string, techniques array<string>")).collect()}
    assert got == {(1, 1, 0, 1), (2, 2, 0, 1), (3, 1, 2, 0)}


def test_cohort_skips_repeated_titles(spark):
    rows = [(1, "p", "t"), (1, "q", "t"), (2, "p", "t"), (2, "q", "t"), (3, "p", "u"), (4, "p", None), (4, "q", None)]
    got = [tuple(r) for r in joins.cohort(spark.createDataFrame(rows, "id long, predicate string, title string"), "id", "predicate", "title", ["p", "q"]).collect()]
    assert got == [("t", min((1, 2), key=lambda k: sha256(str(k).encode()).hexdigest()))]


def test_cache_takes_the_longest_live_key(spark):
    import datetime

    from factloom.operators import corpus

    day = lambda d: datetime.datetime(2024, 1, d)
    cache = spark.createDataFrame([("alpha", day(10)), ("alpha beta", day(10)), ("gamma", day(1)), ("tiny", day(10)), (None, day(10))], "key string, fetched timestamp")
    asked = spark.createDataFrame([(1, "Alpha, beta gamma"), (2, "gamma tiny"), (3, None)], "question_id long, text string")
    assert {tuple(r) for r in corpus.cached(asked, cache, "2024-01-12").collect()} == {(1, "alpha beta"), (2, None), (3, None)}
