"""Registered queries: cohorts, frontiers, resolution, serving overlays, yield and review gates, reports over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import acquisition as acq
from factloom.plans.extracted import pick
from factloom.plans.inference import read
from factloom.plans.shared import query, table, view
from factloom.sources.facts import facts

_WORK_FACTS = "SELECT DISTINCT 'work ' || l_orderkey AS work, 'created_by' AS predicate, 'author ' || l_suppkey AS object FROM lineitem UNION ALL SELECT 'work ' || o_orderkey, 'published_by', 'publisher ' || o_custkey FROM orders WHERE o_orderstatus != 'F'"


@query(_WORK_FACTS)
def work_facts(spark, sf_dir):
    authors = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("author "), "l_suppkey")).alias("authors"))
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("publisher "), "o_custkey")).otherwise("").alias("publisher"))
    works = own.join(authors, "l_orderkey", "full").select(F.concat(F.lit("work "), "l_orderkey").alias("work"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.coalesce("publisher", F.lit("")).alias("publisher"))
    return acq.work_facts(works)


@query(f"WITH f AS ({_WORK_FACTS}) SELECT work, count(*) AS n FROM f WHERE work IN (SELECT work FROM f GROUP BY work HAVING count(DISTINCT predicate) = 2) GROUP BY work")
def multi_predicate_works(spark, sf_dir):
    return acq.with_all_predicates(read(spark, sf_dir, _WORK_FACTS), "work", ("created_by", "published_by")).groupBy("work").agg(F.count("*").alias("n"))


_TOPICS = "SELECT l_orderkey AS work, 'topic ' || (l_partkey % 50) AS topic, l_quantity AS score FROM lineitem"
_REFS = "SELECT l_orderkey AS work, l_partkey AS ref, l_linenumber * 1000000 + l_partkey AS pos FROM lineitem"


@query(f"WITH t AS ({_TOPICS}), b AS (SELECT work, min(topic) AS topic FROM t JOIN (SELECT work, max(score) AS score FROM t GROUP BY work) USING (work, score) GROUP BY work), c AS (SELECT work, arg_min(p_name, pos) AS cites FROM ({_REFS}) JOIN part ON ref = p_partkey WHERE p_size > 20 GROUP BY work) SELECT work, topic, cites FROM b FULL JOIN c USING (work)")
def topic_and_reference(spark, sf_dir):
    titles = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return acq.topic_and_reference(read(spark, sf_dir, _TOPICS), read(spark, sf_dir, _REFS), titles)


_JUDGED = "SELECT 'supplier ' || l_suppkey AS subject, 'sells' AS predicate, 'brand ' || (l_partkey % 25) AS object, CASE WHEN l_returnflag = 'R' THEN 'reject' ELSE 'accept' END AS verdict FROM lineitem"


@query(f"WITH g AS (SELECT * FROM ({_JUDGED}) WHERE verdict = 'accept') SELECT 'entity' AS kind, subject, '' AS predicate, '' AS object FROM g UNION SELECT 'entity', object, '', '' FROM g UNION SELECT 'relation', subject, predicate, object FROM g")
def serving_overlay(spark, sf_dir):
    return acq.serving_overlay(read(spark, sf_dir, _JUDGED))


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 2 = 0 THEN 'P10' END, CASE WHEN p_size % 3 = 0 THEN 'P20' END) AS properties FROM part")
def content_properties(spark, sf_dir):
    has = lambda n, p: F.when(F.col("p_size") % n == 0, F.struct(F.lit(p).alias("key"), F.col("p_size").alias("value")))
    claims = F.map_from_entries(F.array_compact(F.array(has(2, "P10"), has(3, "P20"), has(5, "P31"), has(7, "P99"))))
    kinds = F.create_map(F.lit("P10"), F.lit("item"), F.lit("P20"), F.lit("string"), F.lit("P31"), F.lit("item"), F.lit("P99"), F.lit("external-id"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(acq.content_properties(claims, ("P31",), kinds, ("item", "string")), ",").alias("properties"))


_RELATIONS = "SELECT 'customer ' || o_custkey AS subject, o_orderpriority AS predicate FROM orders UNION ALL SELECT 'part ' || l_partkey, 'in_' || l_returnflag FROM lineitem"


@query(f"SELECT subject, min(predicate) AS predicate, count(*) AS n FROM ({_RELATIONS}) WHERE subject NOT IN (SELECT 'part ' || p_partkey FROM part WHERE p_size > 30) GROUP BY subject HAVING count(DISTINCT predicate) = 1")
def density_frontier(spark, sf_dir):
    seen = table(spark, sf_dir, "part").where("p_size > 30").select(F.concat(F.lit("part "), "p_partkey").alias("subject"))
    return acq.density_frontier(read(spark, sf_dir, _RELATIONS), seen)


_NAMED = "SELECT p_name AS name FROM part UNION SELECT p_brand || ' ' || p_size FROM part"


@query(f"WITH n AS ({_NAMED}), l AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1), a AS (SELECT p_brand || ' ' || p_size AS name, min(p_partkey) AS id FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1) SELECT n.name, coalesce(l.id, a.id, -1) AS id, CASE WHEN l.id IS NOT NULL THEN 'label' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'none' END AS how FROM n LEFT JOIN l USING (name) LEFT JOIN a USING (name)")
def alias_disambiguated_resolution(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_brand", "p_size").alias("alias"))
    return acq.resolved(read(spark, sf_dir, _NAMED), entities).fillna(-1, ["id"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'signup')")
def anchored_resolution(spark, sf_dir):
    anchors = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(anchors, "o_custkey", "left_semi").select("o_orderkey")


_CLAIMS = "SELECT 'order ' || l_orderkey AS subject, CASE l_returnflag WHEN 'R' THEN 'meta' ELSE 'has_' || l_returnflag END AS predicate, 'part ' || l_partkey AS object FROM lineitem"


@query(f"WITH c AS ({_CLAIMS}), s AS (SELECT DISTINCT 'order ' || o_orderkey AS subject FROM orders) SELECT subject, predicate, object, '' AS reason FROM c JOIN s USING (subject) WHERE predicate IN ('has_A', 'has_N') UNION ALL SELECT subject, NULL, NULL, CASE WHEN subject NOT IN (SELECT subject FROM c) THEN 'no_claims' ELSE 'no_content_properties' END FROM s WHERE subject NOT IN (SELECT subject FROM c WHERE predicate IN ('has_A', 'has_N'))")
def property_proposals(spark, sf_dir):
    subjects = table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), "o_orderkey").alias("subject"))
    return acq.proposals(subjects, read(spark, sf_dir, _CLAIMS), ("has_A", "has_N"))


_SOURCES = "SELECT p_name AS title, 4.0::DOUBLE AS weight FROM part UNION ALL SELECT p_type, 2.0 FROM part UNION ALL SELECT o_orderpriority, 1.0 FROM orders UNION ALL SELECT event_type, 0.5 FROM events".replace("::DOUBLE", "")


@query(f"SELECT title, sum(weight)::DOUBLE AS weight FROM ({_SOURCES}) GROUP BY title")
def frontier_extraction(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("title"), F.lit(w).alias("weight")) for t, c, w in (("part", "p_name", 4.0), ("part", "p_type", 2.0), ("orders", "o_orderpriority", 1.0), ("events", "event_type", 0.5))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("title").agg(F.sum("weight").alias("weight"))


@query("WITH f AS (SELECT p_name AS title, count(*)::DOUBLE AS weight FROM part GROUP BY p_name), t AS (SELECT DISTINCT upper(p_name) AS title FROM part WHERE p_size > 45 UNION SELECT p_type FROM part) SELECT coalesce(f.title, t.title) AS title, CASE WHEN t.title IS NOT NULL THEN greatest(coalesce(f.weight, 0), 3.0) ELSE f.weight END AS weight FROM f FULL JOIN t ON lower(f.title) = lower(t.title)")
def broad_seeding(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    frontier = parts.groupBy(F.col("p_name").alias("title")).agg(F.count("*").cast("double").alias("weight"))
    return acq.seeded(frontier, parts.where("p_size > 45").select(F.upper("p_name").alias("title")).union(parts.select("p_type")).distinct(), 3.0)


@query("WITH f AS (SELECT l_partkey AS title, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL), r AS (SELECT title, row_number() OVER (ORDER BY weight DESC, title) - 1 AS rank FROM f) SELECT rank::INT AS rank, title, (rank // 25)::BIGINT AS batch_index, (title IN (SELECT p_partkey FROM part WHERE p_size > 25))::INT AS fetched FROM r WHERE rank < 400")
def allow_list(spark, sf_dir):
    frontier = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("title")).agg(F.sum("l_quantity").alias("weight"))
    return acq.allow_list(frontier, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("title")), 400, 25)


@query("WITH n AS (SELECT p_partkey AS title, 1.0::DOUBLE AS weight FROM part WHERE p_size <= 20 UNION ALL SELECT l_partkey, 1.0 FROM lineitem) SELECT title, sum(weight)::DOUBLE AS weight FROM n WHERE title NOT IN (SELECT p_partkey FROM part WHERE p_size > 40) AND title NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#1') GROUP BY title")
def dynamic_frontier(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "title")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("title"))
    return acq.grown_frontier(parts.where("p_size <= 20").select("title", F.lit(1.0).alias("weight")), links, parts.where("p_size > 40"), parts.where("p_brand = 'Brand#1'"))


_TITLES = f"SELECT p_partkey AS id, {pick('p_partkey % 7', ["p_name", "'List of ' || p_name", "'Category:' || p_type", "CAST(p_size AS STRING)", "'ab'", "upper(p_name)", "'2001'"])} AS title FROM part"


@query(f"SELECT id, (length(trim(title)) BETWEEN 3 AND 80 AND NOT regexp_matches(lower(title), '^(list of|category:|file:|template:|help:|portal:|wikipedia:)') AND NOT regexp_matches(title, '^[0-9 ]+$') AND regexp_matches(lower(title), '[a-z]'))::INT AS usable FROM ({_TITLES})")
def title_hygiene(spark, sf_dir):
    return read(spark, sf_dir, _TITLES).select("id", acq.usable_title(F.col("title")).cast("int").alias("usable"))


@query("SELECT title, min(ord) AS ord FROM (SELECT lower(p_name) AS k, p_name AS title, p_partkey AS ord FROM part) GROUP BY title ORDER BY ord LIMIT 50")
def title_dedupe(spark, sf_dir):
    return acq.first_titles(table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("ord")), 50)


_SCORED = "SELECT p_partkey AS title, p_size * 3 - CASE WHEN p_brand = 'Brand#1' THEN 100 ELSE 0 END - CASE WHEN p_type = 'ECONOMY' THEN 30 ELSE 0 END AS score, CASE WHEN p_brand = 'Brand#1' THEN 'already_fetched' ELSE '' END AS why, CASE WHEN p_type = 'ECONOMY' THEN 'low_yield' ELSE '' END AS also FROM part"


@query(f"SELECT title, score, trim(why || ' ' || also) AS reasons FROM ({_SCORED}) WHERE why != '' OR (also != '' AND score < 20)")
def blocklist(spark, sf_dir):
    rows = read(spark, sf_dir, _SCORED).withColumn("reasons", F.filter(F.array("why", "also"), lambda r: r != ""))
    blocked = F.exists("reasons", lambda r: (r == "already_fetched") | ((r == "low_yield") & (F.col("score") < 20)))
    return rows.where(blocked).select("title", "score", F.array_join("reasons", " ").alias("reasons"))


@query(f"SELECT title, score, CASE WHEN score >= 60 THEN 'high' ELSE 'medium' END AS class FROM ({_SCORED}) WHERE score >= 20")
def high_yield_frontier(spark, sf_dir):
    class_ = F.when(F.col("score") >= 60, "high").when(F.col("score") >= 20, "medium").otherwise("low")
    return read(spark, sf_dir, _SCORED).select("title", "score", class_.alias("class")).where("class IN ('high', 'medium')")


@query("SELECT user_id, event_type AS topic, count(*) AS n FROM events WHERE event_type != 'click' GROUP BY ALL ORDER BY n DESC, user_id, topic LIMIT 40")
def feedback_frontier(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type != 'click'").groupBy("user_id", F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "user_id", "topic").limit(40)


@query("WITH a AS (SELECT l_partkey AS page, count(*) AS n_facts FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT l_partkey AS page, count(*) AS n_candidates FROM lineitem GROUP BY ALL), c AS (SELECT p_partkey AS page, p_size AS n_fetches FROM part WHERE p_size > 0) SELECT page, coalesce(n_facts, 0) AS n_facts, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_fetches, 0)::BIGINT AS n_fetches, CASE WHEN coalesce(n_facts, 0) >= 2 THEN 'high_yield' WHEN coalesce(n_facts, 0) = 0 AND coalesce(n_fetches, 0) >= 3 THEN 'low_yield' ELSE 'neutral' END AS signal FROM a FULL JOIN b USING (page) FULL JOIN c USING (page)")
def yield_signals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page"), "l_returnflag")
    history = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("k"))
    return acq.yield_signals(lines.where("l_returnflag = 'R'"), lines, history)


@query("WITH d AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS f, count(*) AS r FROM events GROUP BY ALL), m AS (SELECT user_id, sum(f)::BIGINT AS facts, sum(r)::BIGINT AS ready, count(*) AS batches, count(*) FILTER (f = 0) AS zero_batches FROM d GROUP BY user_id), b AS (SELECT *, user_id % 13 = 0 OR zero_batches >= batches OR facts / ready < 0.15 AS bad FROM m) SELECT user_id, facts, ready, batches, zero_batches, round(facts / ready, 6) AS yield_per_ready, bad::INT AS blind_unproductive, (NOT bad)::INT AS blind_fetch_allowed, bad::INT AS ranked_fetch_recommended FROM b")
def yield_gate(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("f"), F.count("*").alias("r"))
    metrics = days.groupBy("user_id").agg(F.sum("f").alias("facts"), F.sum("r").alias("ready"), F.count("*").alias("batches"), F.count_if(F.col("f") == 0).alias("zero_batches"))
    return acq.yield_gate(metrics.withColumn("negative", F.col("user_id") % 13 == 0), 0.15).drop("negative")


_REVIEWED = f"SELECT l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS item_id, {pick('l_linenumber % 5', ["'relation'", "'entity'", "'definition'", "'source_fact'", "'context_link'"])} AS kind, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'supplier ' || l_suppkey END AS subject, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE 'part ' || (l_partkey % 40) END AS object, CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE 'page' END AS source_page, CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE 'told' END AS evidence, CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE '2020-01' END AS as_of, CASE WHEN l_orderkey % 3 = 0 THEN 'strong' ELSE 'weak' END AS strength, CASE l_returnflag WHEN 'R' THEN 'volatile' ELSE 'stable' END AS stability, CASE l_linestatus WHEN 'O' THEN 'low' ELSE 'high' END AS confidence FROM lineitem"
_ISSUES = (
    ("item_id != f", "warning", "duplicate_candidate"), ("kind = 'context_link' AND strength != 'weak'", "error", "context_link_not_weak"), ("kind != 'context_link' AND source_page = ''", "error", "missing_source"),
    ("kind = 'entity' AND subject = ''", "error", "entity_card_no_label"), ("kind = 'relation' AND evidence = ''", "error", "missing_evidence"), ("kind = 'relation' AND (subject = '' OR object = '')", "error", "relation_empty_field"),
    ("kind = 'source_fact' AND as_of = ''", "error", "source_fact_without_as_of"), ("kind = 'definition' AND (subject = '' OR object = '')", "error", "definition_empty_field"),
)


@query(f"WITH i AS (SELECT *, min(item_id) OVER (PARTITION BY kind, subject, object) AS f FROM ({_REVIEWED})) " + " UNION ALL ".join(f"SELECT item_id, '{s}' AS severity, '{c}' AS code FROM i WHERE {w}" for w, s, c in _ISSUES))
def review_issues(spark, sf_dir):
    return acq.review_issues(read(spark, sf_dir, _REVIEWED))


@query(f"WITH i AS (SELECT *, min(item_id) OVER (PARTITION BY kind, subject, object) AS f FROM ({_REVIEWED})), r AS (" + " UNION ALL ".join(f"SELECT kind, '{s}' AS severity FROM i WHERE {w}" for w, s, c in _ISSUES) + ") SELECT kind, severity, count(*) AS n FROM r GROUP BY ALL")
def review_summary(spark, sf_dir):
    own = read(spark, sf_dir, _REVIEWED)
    issues = acq.review_issues(own)
    return issues.join(own.select("item_id", "kind").distinct(), "item_id").groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query(f"SELECT item_id, CASE WHEN kind NOT IN ('entity', 'definition', 'relation', 'context_link') OR subject = '' OR (kind = 'relation' AND (confidence = 'low' OR stability = 'volatile')) THEN NULL ELSE 'overlay_' || kind END AS overlay_type, CASE WHEN kind NOT IN ('entity', 'definition', 'relation', 'context_link') THEN 'unsupported_kind' WHEN subject = '' THEN 'empty_subject' WHEN kind = 'relation' AND (confidence = 'low' OR stability = 'volatile') THEN 'unsafe_relation' ELSE '' END AS skipped FROM ({_REVIEWED})")
def overlay_building(spark, sf_dir):
    return acq.overlay_items(read(spark, sf_dir, _REVIEWED))


_SENSES = "SELECT p_name AS term, p_brand AS sense, 'type' AS fact_type, p_type AS value FROM part"


@query(f"WITH s AS (SELECT *, (SELECT count(DISTINCT sense) FROM ({_SENSES}) x WHERE x.term = t.term AND x.value = t.value) AS n FROM ({_SENSES}) t) SELECT term, sense, fact_type, value, CASE WHEN n > 1 THEN 'high' ELSE 'low' END AS risk, CASE WHEN value = 'ECONOMY' THEN 'rejected' WHEN n > 1 THEN 'conflict' ELSE 'accepted' END AS status FROM s")
def normalized_senses(spark, sf_dir):
    return acq.normalized_facts(read(spark, sf_dir, _SENSES), ("ECONOMY",))


_MEMORY = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'R' THEN 'volatile' ELSE 'stable' END AS stability, CASE WHEN l_partkey % 8 = 0 THEN '' ELSE 'p' END AS source_page, CASE l_linestatus WHEN 'O' THEN 'low' ELSE 'high' END AS risk, CASE WHEN l_suppkey % 5 = 0 THEN 'conflict' ELSE 'accepted' END AS status FROM lineitem"


@query(f"SELECT id, CASE WHEN stability = 'volatile' OR source_page = '' THEN 'reject' WHEN risk = 'high' OR status = 'conflict' THEN 'needs_review' ELSE 'accept_auto' END AS decision FROM ({_MEMORY})")
def memory_review(spark, sf_dir):
    return acq.memory_review(read(spark, sf_dir, _MEMORY)).select("id", "decision")


@query(f"SELECT term, sense, string_agg(DISTINCT value, '|' ORDER BY value) AS facts, count(*) AS n FROM ({_SENSES}) GROUP BY term, sense")
def memory_proposals(spark, sf_dir):
    return read(spark, sf_dir, _SENSES).groupBy("term", "sense").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("facts"), F.count("*").alias("n"))


_LED = "SELECT s_suppkey AS page, 'Ann Mae Supplier' || ' is a seller' AS definition, CASE WHEN s_suppkey % 2 = 0 THEN 'Ann Supplier' ELSE 'Supplier ' || s_suppkey END AS label FROM supplier"


@query(f"SELECT page, CASE WHEN label = 'Ann Supplier' THEN 'Ann Mae Supplier,x' ELSE 'x' END AS aliases FROM ({_LED})")
def full_name_aliases(spark, sf_dir):
    own = read(spark, sf_dir, _LED)
    return acq.full_name_aliases(own.select("page", "definition"), own.select("page", "label", F.array(F.lit("x")).alias("aliases"))).select("page", F.array_join("aliases", ",").alias("aliases"))


@query("WITH e AS (SELECT l_suppkey, l_partkey, count(DISTINCT l_orderkey) AS n, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL) SELECT CASE WHEN f != 'R' AND s != 'O' AND n > 1 THEN 'corroborated' WHEN f != 'R' AND s != 'O' THEN 'single_source' ELSE 'withheld' END AS tier, count(*) AS n FROM e GROUP BY 1")
def evidence_grades(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count_distinct("l_orderkey").alias("n"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    grade = acq.evidence_grade(F.col("n"), F.when(F.col("f") == "R", "volatile").otherwise("stable"), F.when(F.col("s") == "O", "high").otherwise("low"))
    return own.select(grade.alias("g")).groupBy("g.tier").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS label, (SELECT string_agg(a, '|' ORDER BY length(a), lower(a), a) FROM (SELECT DISTINCT p_name AS a FROM part q WHERE q.p_brand = p.p_brand)) AS aliases, sum(p_size)::BIGINT AS support FROM part p GROUP BY p_brand")
def graph_coalesce(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("alias"), F.col("p_size").alias("support"))
    return acq.coalesced_entities(own).select("label", F.array_join("aliases", "|").alias("aliases"), F.col("support").cast("long").alias("support"))


@query("WITH s AS (SELECT l_partkey, count(*) AS candidates, count(*) FILTER (l_returnflag = 'R') AS rejected, count(*) FILTER (l_returnflag = 'N') AS accepted FROM lineitem GROUP BY ALL), u AS (SELECT l_partkey, 'candidates' AS measure, candidates AS value FROM s UNION ALL SELECT l_partkey, 'rejected', rejected FROM s UNION ALL SELECT l_partkey, 'accepted', accepted FROM s) SELECT measure, rank, l_partkey, value FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY value DESC, l_partkey) AS rank FROM u) WHERE rank <= 20")
def survival_rankings(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("candidates"), F.count_if(F.col("l_returnflag") == "R").alias("rejected"), F.count_if(F.col("l_returnflag") == "N").alias("accepted"))
    return acq.top_by(own, ("candidates", "rejected", "accepted"), "l_partkey", 20)


@query("SELECT l_shipdate AS batch, count(*) AS planned, count(*) FILTER (l_returnflag != 'R') AS fetched, count(*) FILTER (l_returnflag != 'R' AND l_linestatus = 'F') AS success, count(*) FILTER (l_returnflag != 'R' AND l_linestatus = 'F' AND l_discount >= 0.02) AS ready FROM lineitem GROUP BY ALL")
def batch_funnel(spark, sf_dir):
    fetched = F.col("l_returnflag") != "R"
    good = fetched & (F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").alias("batch")).agg(F.count("*").alias("planned"), F.count_if(fetched).alias("fetched"), F.count_if(good).alias("success"), F.count_if(good & (F.col("l_discount") >= 0.02)).alias("ready"))


@query("SELECT * FROM (SELECT 'returned' AS sink, count(*) FILTER (l_returnflag = 'R') AS lost FROM lineitem UNION ALL SELECT 'open', count(*) FILTER (l_linestatus = 'O') FROM lineitem UNION ALL SELECT 'discounted', count(*) FILTER (l_discount > 0.05) FROM lineitem UNION ALL SELECT 'small', count(*) FILTER (l_quantity < 10) FROM lineitem) ORDER BY lost DESC, sink LIMIT 3")
def sink_classification(spark, sf_dir):
    sinks = {"returned": "l_returnflag = 'R'", "open": "l_linestatus = 'O'", "discounted": "l_discount > 0.05", "small": "l_quantity < 10"}
    one = table(spark, sf_dir, "lineitem").agg(*(F.count_if(F.expr(c)).alias(n) for n, c in sinks.items()))
    flat = F.array(*(F.struct(F.lit(n).alias("sink"), F.col(n).alias("lost")) for n in sinks))
    return one.select(F.explode(flat).alias("s")).select("s.sink", "s.lost").orderBy(F.desc("lost"), "sink").limit(3)


@query("SELECT groups, count(*) AS n_subjects FROM (SELECT l_suppkey, count(DISTINCT l_returnflag || l_linestatus) AS groups FROM lineitem GROUP BY ALL) GROUP BY groups")
def heldout_density(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.concat("l_returnflag", "l_linestatus")).alias("groups"))
    return own.groupBy("groups").agg(F.count("*").alias("n_subjects"))


@query("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS accuracy, round(avg((value > 20)::INT), 6) AS supported, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def benchmark_evaluation(spark, sf_dir):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    cut = lambda p: F.round(F.percentile("value", p), 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), share(F.col("value") > 50).alias("accuracy"), share(F.col("value") > 20).alias("supported"), cut(0.5).alias("p50"), cut(0.95).alias("p95"))


@query("SELECT stage, count(*) AS n FROM (SELECT CASE WHEN l_partkey % 9 = 0 THEN 'entity_not_found' WHEN l_returnflag = 'R' THEN 'relation_not_resolved' WHEN l_linestatus = 'O' THEN 'no_supported_fact' WHEN l_discount > 0.08 THEN 'not_rendered' ELSE 'passed' END AS stage FROM lineitem) GROUP BY stage")
def failure_stages(spark, sf_dir):
    stage = acq.failure_stage(F.col("l_partkey") % 9 != 0, F.col("l_returnflag") != "R", F.col("l_linestatus") != "O", F.col("l_discount") <= 0.08)
    return table(spark, sf_dir, "lineitem").select(stage.alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT DISTINCT 's' || l_suppkey AS subject, 'r' || l_returnflag AS predicate, 's' || (l_partkey % 50) AS object FROM lineitem), q AS (SELECT DISTINCT 's' || s_suppkey AS anchor, 'rR' AS relation FROM supplier WHERE s_suppkey < 50) SELECT anchor, relation, object AS holder FROM q JOIN f ON anchor = subject AND relation = predicate UNION SELECT anchor, relation, subject FROM q JOIN f ON anchor = object AND relation = predicate")
def role_holders(spark, sf_dir):
    own = read(spark, sf_dir, "SELECT DISTINCT 's' || l_suppkey AS subject, 'r' || l_returnflag AS predicate, 's' || (l_partkey % 50) AS object FROM lineitem")
    return acq.role_holders(own, read(spark, sf_dir, "SELECT DISTINCT 's' || s_suppkey AS anchor, 'rR' AS relation FROM supplier WHERE s_suppkey < 50"))


@query(view("owned_by", "located_in") + "SELECT subject AS surface FROM facts UNION SELECT object FROM facts")
def graph_surfaces(spark, sf_dir):
    own = facts(spark, sf_dir, "owned_by", "located_in")
    return own.select(F.col("subject").alias("surface")).union(own.select("object")).distinct()


@query("SELECT CASE WHEN l_returnflag = 'R' THEN 'functional_conflict' WHEN l_linestatus = 'O' THEN 'inverse_conflict' ELSE 'none' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def conflict_breakdown(spark, sf_dir):
    reason = F.when(F.col("l_returnflag") == "R", "functional_conflict").when(F.col("l_linestatus") == "O", "inverse_conflict").otherwise("none")
    return table(spark, sf_dir, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
