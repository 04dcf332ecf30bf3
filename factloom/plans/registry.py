"""Registered queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.policy import answerable, hop_reason, hop_safe
from factloom.operators import algebra, causal, events, graph, measures, out_of_fold, routing, rules, text
from factloom.plans import acquisition, beams, contexts, derived, extracted, inference, knowledge, lookups, pages, records, retrieval, styles  # noqa: F401 - they register their queries
from factloom.plans.shared import ALERTS, PLAIN, QUERIES, REASON, SQL, TOKENS, Query, query, table, view
from factloom.sources.facts import facts, supplies
from factloom.functions.lineage import cut, shared_path
from factloom.streaming import audit
from factloom.streaming import causal as causal_stream
from factloom.streaming.features import streamed_frequencies

# --- algebra ---


@query(view("located_in", "part_of") + "SELECT b.object AS region, count(*) AS n FROM safe a JOIN safe b ON a.object = b.subject WHERE a.predicate = 'located_in' AND b.predicate = 'part_of' GROUP BY b.object")
def traverse_two_hop(spark, sf_dir):
    chains = algebra.traverse(facts(spark, sf_dir, "located_in", "part_of"), "located_in", "part_of")
    return chains.groupBy(F.col("object").alias("region")).agg(F.count("*").alias("n"))


FLAGSHIP = traverse_two_hop


@query(view("owned_by") + "SELECT subject, predicate, object, as_of FROM safe WHERE lower(object) = 'customer#000000001'")
def find_subject(spark, sf_dir):
    return algebra.find(facts(spark, sf_dir, "owned_by"), predicate="owned_by", object="Customer#000000001").select("subject", "predicate", "object", "as_of")


@query(view() + "SELECT subject, predicate, object FROM safe WHERE lower(subject) IN ('part 1')")
def find_object(spark, sf_dir):
    return algebra.find(facts(spark, sf_dir), subject="the Part 1").select("subject", "predicate", "object")


@query(view("owned_by") + "SELECT subject, object, as_of FROM safe WHERE stability = 'semi_stable' AND temporal_class = 'snapshot'")
def filter_metadata(spark, sf_dir):
    found = algebra.find(facts(spark, sf_dir, "owned_by"), predicate="owned_by")
    return algebra.filter_metadata(found, "semi_stable", "snapshot").select("subject", "object", "as_of")


@query(view("owned_by", "located_in") + "SELECT a.subject, a.object, string_agg(DISTINCT b.object, ',' ORDER BY b.object) AS places FROM safe a JOIN safe b ON lower(a.object) = lower(b.subject) WHERE a.predicate = 'owned_by' AND b.predicate = 'located_in' AND b.object = 'NATION_3' GROUP BY a.subject, a.object")
def filter_secondary_relation(spark, sf_dir):
    own = facts(spark, sf_dir, "owned_by", "located_in")
    out = algebra.filter_secondary(algebra.find(own, predicate="owned_by"), own, "located_in", "nation_3")
    return out.select("subject", "object", F.array_join("secondary_objects", ",").alias("places"))


@query(view("published_by") + "SELECT object AS brand, count(*) AS n, count(DISTINCT object) AS n_objects, arg_min(subject, ord) AS earliest, arg_max(subject, ord) AS latest FROM safe GROUP BY object")
def aggregate_first_last(spark, sf_dir):
    found = algebra.find(facts(spark, sf_dir, "published_by"), predicate="published_by").withColumn("brand", F.col("object"))
    return found.groupBy("brand").agg(F.count("*").alias("n"), F.count_distinct("object").alias("n_objects"), F.min_by("subject", "ord").alias("earliest"), F.max_by("subject", "ord").alias("latest"))


_LINES = "WITH s AS (SELECT DISTINCT l_suppkey AS subject, l_partkey AS object FROM lineitem) "


@query(_LINES + "SELECT object FROM s WHERE subject = 1 AND object IN (SELECT object FROM s WHERE subject = 2)")
def compare_intersection(spark, sf_dir):
    own = supplies(spark, sf_dir).withColumn("predicate", F.lit("produces"))
    return algebra.compare(own.where("subject = 1"), own.where("subject = 2"), "intersection").select("object")


@query(_LINES + "SELECT object FROM s WHERE subject = 1 AND object NOT IN (SELECT object FROM s WHERE subject = 2)")
def compare_difference(spark, sf_dir):
    own = supplies(spark, sf_dir).withColumn("predicate", F.lit("produces"))
    return algebra.compare(own.where("subject = 1"), own.where("subject = 2"), "difference").select("object")


@query(_LINES + "SELECT *, CASE WHEN count_a > count_b THEN 'a' WHEN count_a < count_b THEN 'b' ELSE 'equal' END AS larger FROM (SELECT count(*) FILTER (subject = 1) AS count_a, count(*) FILTER (subject = 2) AS count_b FROM s)")
def compare_size(spark, sf_dir):
    own = supplies(spark, sf_dir)
    return algebra.compare_size(own.where("subject = 1"), own.where("subject = 2"))


@query(view() + f"SELECT predicate, coalesce({REASON}, 'safe') AS reason, count(*) AS n FROM facts GROUP BY ALL")
def hop_safety_reasons(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("predicate", F.coalesce(hop_reason(), F.lit("safe")).alias("reason")).agg(F.count("*").alias("n"))


@query(view() + "SELECT predicate, count(*) FILTER (stability IN ('stable', 'semi_stable') AND predicate NOT IN ('leader_of', 'valued_at') AND lower(risk) != 'high') AS n_answerable, count(*) AS n FROM facts GROUP BY predicate")
def answerable_relations(spark, sf_dir):
    return facts(spark, sf_dir).groupBy("predicate").agg(F.sum(answerable().cast("long")).alias("n_answerable"), F.count("*").alias("n"))


@query(view("is_a", "published_by") + "SELECT subject, count(DISTINCT predicate) AS n_present, CASE WHEN max(CASE WHEN predicate = 'published_by' THEN 1 ELSE 0 END) = 0 THEN 'published_by' WHEN max(CASE WHEN predicate = 'is_a' THEN 1 ELSE 0 END) = 0 THEN 'is_a' ELSE '' END AS missing FROM safe GROUP BY subject")
def and_query(spark, sf_dir):
    return algebra.has_all(facts(spark, sf_dir, "is_a", "published_by"), ["is_a", "published_by"])


@query(view("owned_by", "located_in") + "SELECT b.object AS nation, count(*) AS n FROM safe a JOIN safe b ON a.object = b.subject WHERE a.predicate = 'owned_by' AND b.predicate = 'located_in' GROUP BY b.object")
def chain_query(spark, sf_dir):
    chains = algebra.traverse(facts(spark, sf_dir, "owned_by", "located_in"), "owned_by", "located_in")
    return chains.groupBy(F.col("object").alias("nation")).agg(F.count("*").alias("n"))


@query(_LINES + "SELECT object, a, subject AS b, members FROM s JOIN (SELECT object, min(subject) AS a, count(*) AS members FROM s GROUP BY object HAVING count(*) >= 2) USING (object) WHERE subject != a")
def co_attribution_pairs(spark, sf_dir):
    return algebra.co_attribution(supplies(spark, sf_dir))


@query(_LINES + ", q AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier) SELECT a, b, count(*) AS shared FROM q JOIN s x ON x.subject = a JOIN s y ON y.subject = b AND y.object = x.object GROUP BY a, b")
def co_attribution_for_pair(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return algebra.co_attribution_of(supplies(spark, sf_dir), asked)


@query(view() + "SELECT predicate, count(*) AS subjects, round(avg(k), 6) AS avg_objects, max(k) AS max_objects FROM (SELECT predicate, subject, count(DISTINCT object) AS k FROM facts GROUP BY ALL) GROUP BY predicate")
def relation_functionality(spark, sf_dir):
    return algebra.functionality(facts(spark, sf_dir))


_CLAIMS = "(SELECT 'order ' || l_orderkey AS subject, 'has_status' AS predicate, l_linestatus AS object FROM lineitem)"


@query(f"WITH c AS {_CLAIMS}, k AS (SELECT predicate, subject, count(DISTINCT object) AS k FROM c GROUP BY ALL), m AS (SELECT predicate FROM k GROUP BY predicate HAVING count(*) >= 3 AND round(avg(k), 6) <= 1.34 AND max(k) < 3) SELECT subject, predicate, min(object) AS first_object, max(object) AS second_object FROM c WHERE predicate IN (FROM m) GROUP BY ALL HAVING min(object) != max(object)")
def conflict_pairs(spark, sf_dir):
    claims = spark.sql(f"SELECT * FROM {_CLAIMS.replace('FROM lineitem', 'FROM {lines}')}", lines=table(spark, sf_dir, "lineitem"))
    return algebra.conflicts(claims)


# --- graph and rules ---


@query(view("is_a", "part_of", "located_in") + ", e AS (SELECT DISTINCT subject, object FROM safe), w AS (WITH RECURSIVE w(subject, object, hops) AS (SELECT subject, object, 1 FROM e UNION ALL SELECT w.subject, e.object, hops + 1 FROM w JOIN e ON w.object = e.subject WHERE hops < 6) SELECT subject, object, min(hops) AS hops FROM w WHERE subject != object GROUP BY ALL) SELECT object, hops, count(*) AS n FROM w GROUP BY ALL")
def isa_closure(spark, sf_dir):
    edges = facts(spark, sf_dir, "is_a", "part_of", "located_in").where(hop_safe()).select("subject", "object").distinct()
    return graph.closure(edges).groupBy("object", F.col("hops").cast("long").alias("hops")).agg(F.count("*").alias("n"))


@query(view("part_of", "located_in") + """, e AS (SELECT subject AS a, object AS b FROM safe UNION SELECT object, subject FROM safe),
 w AS (WITH RECURSIVE w(start, node, hops) AS (SELECT DISTINCT subject, subject, 0 FROM safe WHERE predicate = 'part_of' UNION SELECT start, e.b, hops + 1 FROM w JOIN e ON w.node = e.a WHERE hops < 3) SELECT start, node, min(hops) AS hops FROM w GROUP BY ALL)
 SELECT start, hops::BIGINT AS hops, count(*) AS n FROM w GROUP BY ALL""")
def shortest_path_bounded(spark, sf_dir):
    own = facts(spark, sf_dir, "part_of", "located_in").where(hop_safe())
    starts = own.where("predicate = 'part_of'").select(F.col("subject").alias("start")).distinct()
    found = graph.shortest_paths(own.select("subject", "object"), starts)
    return found.groupBy("start", F.col("hops").cast("long").alias("hops")).agg(F.count("*").alias("n"))


CHAIN = rules.Rule("classification_chain", (("?a", "is_a", "?b"), ("?b", "is_a", "?c")), ("?a", "is_a", "?c"))
ORIGIN = rules.Rule("order_origin", (("?a", "owned_by", "?b"), ("?b", "located_in", "?c")), ("?a", "originates_in", "?c"))
_SCORE = "CASE {0}.stability WHEN 'stable' THEN 1.0 WHEN 'semi_stable' THEN 0.7 WHEN 'volatile' THEN 0.3 ELSE 0.5 END::DOUBLE"


@query(view("is_a") + f"SELECT a.subject, 'is_a' AS predicate, b.object, max(least({_SCORE.format('a')}, {_SCORE.format('b')})) AS confidence, 'classification_chain' AS rule FROM facts a JOIN facts b ON a.object = b.subject WHERE a.subject != b.object GROUP BY a.subject, b.object")
def rule_classification_chain(spark, sf_dir):
    return rules.infer(facts(spark, sf_dir, "is_a"), CHAIN)


@query(view("owned_by", "located_in") + f"SELECT b.object, 'originates_in' AS predicate, least({_SCORE.format('a')}, {_SCORE.format('b')}) AS confidence, count(DISTINCT a.subject) AS n FROM facts a JOIN facts b ON a.object = b.subject WHERE a.predicate = 'owned_by' AND b.predicate = 'located_in' GROUP BY ALL")
def rule_order_origin(spark, sf_dir):
    found = rules.infer(facts(spark, sf_dir, "owned_by", "located_in"), ORIGIN)
    return found.groupBy("object", "predicate", "confidence").agg(F.count("*").alias("n"))


@query(view("is_a", "published_by") + ", m AS (SELECT DISTINCT subject, object AS class FROM facts WHERE predicate = 'is_a' AND subject LIKE 'part %'), z AS (SELECT class, count(*) AS population FROM m GROUP BY class) SELECT class, predicate, object, count(*) AS support, population, round(count(*) / population, 6) AS confidence FROM m JOIN (SELECT DISTINCT subject, predicate, object FROM facts WHERE predicate = 'published_by') USING (subject) JOIN z USING (class) GROUP BY class, predicate, object, population HAVING count(*) >= 2 AND round(count(*) / population, 6) >= 0.04")
def pattern_class_implication(spark, sf_dir):
    own = facts(spark, sf_dir, "is_a", "published_by")
    members = own.where("predicate = 'is_a' AND subject LIKE 'part %'").select("subject", F.col("object").alias("class")).distinct()
    return rules.class_implications(members, own.where("predicate = 'published_by'"), 2, 0.04)


# --- measures ---


@query("SELECT l_suppkey, l_partkey, count(*) AS support, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS sources, (count(DISTINCT l_returnflag) > 1)::INT AS corroborated FROM lineitem GROUP BY ALL")
def evidence_edge_merge(spark, sf_dir):
    return measures.merged_evidence(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], "l_returnflag")


@query("SELECT CASE WHEN k < 3 THEN k::VARCHAR WHEN k < 5 THEN '3-4' WHEN k < 10 THEN '5-9' ELSE '10+' END AS bucket, count(*) AS n_groups FROM (SELECT o_orderkey, count(l_orderkey) AS k FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) GROUP BY bucket")
def density_histogram(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return measures.density(table(spark, sf_dir, "orders"), lines, "o_orderkey")


@query("SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def eval_percentiles(spark, sf_dir):
    return measures.percentiles(table(spark, sf_dir, "events"), "event_type", "value")


_FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT field, n_rows, n_missing, round(n_missing / greatest(n_rows, 1), 6) AS missing_share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n_rows, count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '') AS n_missing FROM documents" for c in _FIELDS) + ")")
def field_completeness(spark, sf_dir):
    return measures.completeness(table(spark, sf_dir, "documents"), list(_FIELDS))


@query("SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def source_breakdown(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT title, sum(weight)::BIGINT AS weight, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM (SELECT n_name AS title, 'customer' AS source, 1 AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, 'supplier', 5 FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY title")
def frontier_merge(spark, sf_dir):
    own = facts(spark, sf_dir, "located_in").select(F.col("object").alias("title"), F.when(F.col("ord") < 1_000_000_000, "customer").otherwise("supplier").alias("source"))
    return measures.merged_frontier([own.withColumn("weight", F.when(F.col("source") == "customer", 1).otherwise(5).cast("long"))])


@query("SELECT o_orderkey, o_orderstatus, age_days, ratio, rank() OVER (PARTITION BY o_orderstatus ORDER BY ratio DESC) AS rank FROM (SELECT o_orderkey, o_orderstatus, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS age_days, round(date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / CASE o_orderstatus WHEN 'F' THEN 365 WHEN 'O' THEN 30 ELSE 90 END, 6) AS ratio FROM orders)")
def staleness_ranking(spark, sf_dir):
    return measures.staleness(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", "2002-01-01", {"F": 365, "O": 30, "P": 90}, "o_orderstatus")


# --- event stream ---

_BEFORE = "count(*) OVER (PARTITION BY {0} ORDER BY us RANGE BETWEEN {1} PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY {0}, us) + row_number() OVER (PARTITION BY {0}, us ORDER BY event_id) - 1"
_DAY, _WEEK, _QUARTER = 24 * events.HOUR, 168 * events.HOUR, events.HOUR // 4


def _alerts(spark, sf_dir):
    return events.alerts(table(spark, sf_dir, "events"))


@query(ALERTS + f"SELECT event_id, {_BEFORE.format('actor, host, technique', _DAY)} AS freq_24h, {_BEFORE.format('actor, technique', _WEEK)} AS freq_7d FROM a")
def event_frequencies(spark, sf_dir):
    return events.frequencies(_alerts(spark, sf_dir)).select("event_id", "freq_24h", "freq_7d")


@query(SQL["event_frequencies"])
def stream_frequencies(spark, sf_dir):
    """The trailing counts of the event stream, by its stateful twin: all that is there now, file by file."""
    return streamed_frequencies(spark, f"{sf_dir}/events.parquet")


_FIRST = "(row_number() OVER (PARTITION BY {0} ORDER BY us, event_id) = 1)::INT"


@query(ALERTS + f"SELECT event_id, {_FIRST.format('actor')} AS novel_actor, {_FIRST.format('actor, host')} AS novel_host_for_actor, {_FIRST.format('actor, host, technique')} AS novel_actor_host_technique FROM a")
def novelty_flags(spark, sf_dir):
    return events.novelty(_alerts(spark, sf_dir)).select("event_id", "novel_actor", "novel_host_for_actor", "novel_actor_host_technique")


@query(ALERTS + ", b AS (SELECT *, hour(ts) // 6 + CASE WHEN dayofweek(ts) IN (0, 6) THEN 4 ELSE 0 END AS band FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY actor, band ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS same, count(*) OVER (PARTITION BY actor ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total FROM b) SELECT event_id, band::BIGINT AS band, round((same + 1) / (total + 8), 6) AS typicality, (same = 0)::INT AS never_active FROM c")
def time_typicality(spark, sf_dir):
    return events.time_typicality(_alerts(spark, sf_dir)).select("event_id", "band", "typicality", "never_active")


@query(ALERTS + f"SELECT x.event_id, count(DISTINCT y.technique) AS diversity FROM a x JOIN a y ON x.actor = y.actor AND y.us BETWEEN x.us - {_QUARTER} AND x.us AND (y.us < x.us OR y.event_id <= x.event_id) GROUP BY x.event_id")
def tactic_diversity_15m(spark, sf_dir):
    return events.diversity(_alerts(spark, sf_dir)).select("event_id", "diversity")


@query(ALERTS + f"SELECT event_id, coalesce(technique IN ('purchase', 'error') AND us - max(CASE WHEN technique = 'view' THEN us END) OVER (PARTITION BY actor ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {_QUARTER}, false)::INT AS escalation FROM a")
def escalation_chain(spark, sf_dir):
    return events.escalation(_alerts(spark, sf_dir), "view", ("purchase", "error")).select("event_id", "escalation")


@query("WITH d AS (SELECT list_sort(list(DISTINCT ts::DATE)) AS d FROM events) SELECT CASE WHEN ts::DATE < d[floor(len(d) * 0.7)::INT + 1] THEN 'train' ELSE 'test' END AS part, event_type, count(*) AS n FROM events, d GROUP BY ALL")
def chronological_split(spark, sf_dir):
    split = events.chronological_split(table(spark, sf_dir, "events"))
    return split.groupBy("part", "event_type").agg(F.count("*").alias("n"))


@query(ALERTS + "SELECT incident_id, event_id, gap_us FROM (SELECT x.event_id AS incident_id, y.event_id, abs(x.us - y.us) AS gap_us, row_number() OVER (PARTITION BY x.event_id ORDER BY abs(x.us - y.us), y.event_id) AS n FROM a x JOIN a y ON x.actor = y.actor AND abs(x.us - y.us) <= 3600000000 WHERE x.technique = 'signup') WHERE n <= 10")
def incident_interval_join(spark, sf_dir):
    own = _alerts(spark, sf_dir)
    return events.near_incidents(own, own.where("technique = 'signup'").withColumnRenamed("event_id", "incident_id"), events.HOUR)


# --- text ---

_GRAMS = "list_transform(range(1, greatest(len(w) - {0} + 2, 1)), lambda k: array_to_string(list_slice(w, k, k + {0} - 1), ' '))"


@query(f"WITH h AS (SELECT doc_id, substr(sha256({PLAIN.format('text')}), 1, 16) AS hash FROM documents) SELECT doc_id, hash, min(doc_id) OVER (PARTITION BY hash) AS first_doc, (doc_id != min(doc_id) OVER (PARTITION BY hash))::INT AS is_duplicate FROM h")
def dedupe_content_hash(spark, sf_dir):
    return text.duplicates(table(spark, sf_dir, "documents"))


_GATE = f"SELECT doc_id, CASE WHEN coalesce(trim(text), '') IN ('', '[deleted]', '[removed]') THEN 'deleted_or_empty' WHEN length(text) < 40 THEN 'too_short' WHEN contains(text, '!! ') THEN 'shouting' WHEN len(list_distinct({TOKENS.format('text')})) * 4 < len({TOKENS.format('text')}) THEN 'repetitive' ELSE 'accept' END AS verdict FROM documents"


@query(_GATE)
def community_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.gate(F.col("text")).alias("verdict"))


@query(f"WITH g AS ({_GATE}), c AS (SELECT count(*) FILTER (quality = 0 AND verdict != 'accept') AS tp, count(*) FILTER (quality != 0 AND verdict != 'accept') AS fp, count(*) FILTER (quality = 0 AND verdict = 'accept') AS fn, count(*) FILTER (quality != 0 AND verdict = 'accept') AS tn FROM g JOIN labels USING (doc_id)) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c")
def gate_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return measures.classification(rows, F.col("quality") == 0, text.gate(F.col("text")) != "accept")


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), g AS (SELECT doc_id, unnest({_GRAMS.format(2)}) AS ngram FROM t) SELECT ngram, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_documents FROM g GROUP BY ngram HAVING count(*) >= 2")
def ngram_counts(spark, sf_dir):
    return text.ngram_counts(table(spark, sf_dir, "documents"), 2)


@query(f"WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), t AS (SELECT {TOKENS.format('line')} AS w FROM l), p AS (SELECT w, k, unnest([1, 2, 3, 4]) AS lag FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM t)), q AS (SELECT least(w[k], w[k + lag]) AS a, greatest(w[k], w[k + lag]) AS b FROM p WHERE k + lag <= len(w) AND w[k] != w[k + lag]) SELECT a, b, count(*) AS weight FROM q GROUP BY a, b HAVING count(*) >= 5")
def cooccurrence_edges(spark, sf_dir):
    return text.cooccurrence(table(spark, sf_dir, "documents"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), g AS (SELECT DISTINCT doc_id, unnest({_GRAMS.format(4)}) AS gram FROM t), k AS (SELECT DISTINCT unnest({_GRAMS.format(4)}) AS gram FROM (SELECT {TOKENS.format('text')} AS w FROM benchmark)) SELECT doc_id, count(*) AS n_shared FROM g JOIN k USING (gram) GROUP BY doc_id")
def novelty_guard(spark, sf_dir):
    return text.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LONG = f"unnest(list_distinct(list_filter({TOKENS.format('text')}, lambda t: length(t) >= 9)))"


@query(f"WITH d AS (SELECT doc_id, {_LONG} AS word FROM documents), b AS (SELECT item_id, {_LONG} AS word FROM benchmark), h AS (SELECT item_id, doc_id, count(*) AS matched FROM d JOIN b USING (word) GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY matched DESC, doc_id) AS rank, doc_id, matched FROM h) WHERE rank <= 3")
def lexical_search(spark, sf_dir):
    return text.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), r AS (" + " UNION ".join(f"SELECT doc_id, '{name}' AS predicate, regexp_extract(line, '{pattern}', 1) AS object FROM l" for name, pattern in text.PATTERNS) + ") SELECT * FROM r WHERE object != ''")
def relation_extraction(spark, sf_dir):
    return text.extracted_relations(table(spark, sf_dir, "documents"))


@query(f"WITH t AS (SELECT role, unnest({TOKENS.format('text')}) AS term FROM conversations), c AS (SELECT role, term, count(*) AS n FROM t GROUP BY ALL) SELECT * FROM (SELECT role, row_number() OVER (PARTITION BY role ORDER BY n DESC, term) AS rank, term, n FROM c) WHERE rank <= 50")
def speaking_profile(spark, sf_dir):
    return text.top_terms(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, count(*) OVER w AS turn_counter, (count(*) FILTER (role = 'assistant') OVER w)::BIGINT AS confirmed_counter FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def dialogue_counters(spark, sf_dir):
    return text.turn_counters(table(spark, sf_dir, "conversations"))


# --- vectors ---

_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0), m AS (SELECT label, dim, avg(v[dim + 1]) AS m FROM u, (SELECT unnest(range(64)) AS dim) GROUP BY ALL), c AS (SELECT label, dim, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS value FROM m)"


@query(f"WITH {_UNIT} SELECT label, dim::INT AS dim, round(value, 6) AS value FROM c")
def centroid_build(spark, sf_dir):
    return measures.centroids(table(spark, sf_dir, "embeddings")).withColumn("value", F.round("value", 6))


@query(f"WITH {_UNIT}, k AS (SELECT label, list(value ORDER BY dim) AS c FROM c GROUP BY label), s AS (SELECT vec_id, k.label, round(list_dot_product(v, c), 6) AS score FROM u, k), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS n FROM s) SELECT a.label AS best_label, CASE WHEN a.score >= 0.5 AND a.score - b.score >= 0.1 THEN 'match' ELSE 'abstain' END AS decision, count(*) AS n FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2 GROUP BY ALL")
def centroid_margin_classify(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    found = measures.nearest_centroid(own, measures.centroids(own), 0.5, 0.1)
    return found.groupBy("best_label", "decision").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- all causal features of an event ---


@query("SELECT event_id, freq_24h, freq_7d, diversity, escalation, chain_novel FROM (" + SQL["event_frequencies"] + ") JOIN (" + SQL["tactic_diversity_15m"] + ") USING (event_id) JOIN (" + SQL["escalation_chain"] + ") USING (event_id) JOIN (" + SQL["process_chain_novelty"] + ") USING (event_id)")
def causal_features(spark, sf_dir):
    """Trailing counts, diversity, escalation and chain novelty of each event, from one pass over an actor's windows."""
    rows = events.escalation(events.diversity(events.frequencies(_alerts(spark, sf_dir))), "view", ("purchase", "error"))
    return rows.select("event_id", "freq_24h", "freq_7d", "diversity", "escalation").join(QUERIES["process_chain_novelty"](spark, sf_dir), "event_id")


# --- alerts with actors, techniques and processes, derived from the events; their features in batch and as a stream ---

_TECHNIQUE = {"view": "Discovery", "signup": "Discovery", "click": "Execution", "purchase": "Credential Access", "error": "Lateral Movement"}
_ALERTED = "element_at(array('view', 'click', 'signup', 'purchase', 'error'), CAST(k % 5 AS INT) + 1)"


def _security_alerts(rows):
    """Alerts of event rows; a row without an id stays one without an id."""
    rows = rows.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    of = lambda c: F.create_map(*(F.lit(x) for kv in _TECHNIQUE.items() for x in kv))[c]
    second = F.expr(_ALERTED)
    user = F.col("user_id")
    return rows.select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.when(user % 50 == 49, "collector").otherwise("main").alias("node"),
        F.when(F.coalesce(F.col("value") < 1, F.lit(False)), "other").otherwise("process_creation").alias("category"),
        F.when(user % 4 == 0, F.concat(F.lit("u"), user)).when(user % 4 == 1, "  ").alias("subject_user"), F.when(user % 8 == 0, "D").alias("subject_domain"),
        F.when((user % 4).isin(1, 2), F.concat(F.lit("CORP\\u"), user)).when(user % 12 == 3, "CORP\\").when(user % 12 == 7, F.concat(F.lit("v"), user)).alias("event_user"),
        F.concat(F.lit("h"), F.col("k") % 5).alias("host"),
        F.when(F.col("k") % 10 == 7, F.lit(None)).when(F.col("k") % 3 == 0, F.array("event_type", second)).otherwise(F.array("event_type")).alias("techniques"),
        F.when(F.col("k") % 3 == 0, F.array(of(F.col("event_type")), of(second))).otherwise(F.array(of(F.col("event_type")))).alias("tactics"),
        F.concat(F.lit("p"), F.col("k") % 7).alias("parent"), F.when(F.col("k") % 13 != 0, F.concat(F.lit("i"), F.col("k") % 11)).alias("image"),
    )


def _features_sql(mode: str) -> str:
    """Joins of each alert with the alerts before it."""
    pair = {"Discovery": ("view", "signup"), "Execution": ("click",), "Credential Access": ("purchase",), "Lateral Movement": ("error",)}
    of = lambda c: "CASE " + " ".join(f"WHEN {c} = '{t}' THEN '{k}'" for k, ts in pair.items() for t in ts) + " END"
    second = "['view', 'click', 'signup', 'purchase', 'error'][k % 5 + 1]"
    kept, read = ("[:1]", "[:1]") if mode == "first_only" else ("", "" if mode == "aggregate" else "[:1]")
    names = causal.feature_names(mode)
    return f"""WITH e AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
 b AS (SELECT event_id, epoch_us(ts) AS us, ts, 'h' || k % 5 AS host, CASE WHEN user_id % 4 = 0 THEN 'u' || user_id || '|' || CASE WHEN user_id % 8 = 0 THEN 'D' ELSE '' END WHEN user_id % 4 IN (1, 2) THEN 'u' || user_id || '|CORP' WHEN user_id % 12 = 7 THEN 'v' || user_id || '|' ELSE '(host:h' || k % 5 || ')|' END AS actor,
  (user_id % 4 != 0)::INT AS missing, (user_id % 4 = 3 AND user_id % 12 != 7)::INT AS fallback, CASE WHEN k % 10 = 7 THEN [NULL] WHEN k % 3 = 0 THEN list_distinct_ordered(event_type, {second}) ELSE [event_type] END AS t,
  CASE WHEN k % 3 = 0 THEN list_distinct_ordered({of('event_type')}, {of(second)}) ELSE [{of('event_type')}] END AS c, 'p' || k % 7 AS parent, CASE WHEN k % 13 != 0 THEN 'i' || k % 11 ELSE '{causal.NO_IMAGE}' END AS image,
  hour(ts) // 6 + CASE WHEN dayofweek(ts) IN (0, 6) THEN 4 ELSE 0 END AS band FROM e WHERE user_id % 50 != 49 AND value >= 1),
 a AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS n FROM b),
 ft AS (SELECT n, us, actor, host, unnest(t{kept}) AS t FROM a), rt AS (SELECT n, us, actor, host, unnest(t{read}) AS t FROM a),
 f1 AS (SELECT r.n, r.t, count(f.n) FILTER (f.host = r.host AND r.us - f.us <= {causal.DAY}) AS d, count(f.n) FILTER (r.us - f.us <= {causal.WEEK}) AS w, count(f.n) FILTER (f.host = r.host) = 0 AS new FROM rt r LEFT JOIN ft f ON f.actor = r.actor AND f.t IS NOT DISTINCT FROM r.t AND f.n < r.n GROUP BY r.n, r.t),
 f2 AS (SELECT n, min(d) AS d, min(w) AS w, max(new::INT) AS new FROM f1 GROUP BY n),
 p AS (SELECT x.n, count(y.n) AS total, count(y.n) FILTER (y.band = x.band) AS same, count(y.n) FILTER (y.host = x.host) = 0 AS new_host, coalesce(flatten(list(y.c{kept}) FILTER (y.host = x.host AND x.us - y.us <= {causal.CHAIN})), []) AS live FROM a x LEFT JOIN a y ON y.actor = x.actor AND y.n < x.n GROUP BY x.n)
SELECT event_id, d AS {names[0]}, w AS {names[1]}, new::INT AS {names[2]}, new_host::INT AS {names[3]}, (total = 0)::INT AS {names[4]}, round((same + 1) / (total + 8), 6) AS {names[5]}, (same = 0)::INT AS {names[6]}, len(list_distinct(live || c{read}))::BIGINT AS {names[7]},
 (list_contains(live, 'Discovery') AND list_has_any(c{read}, ['Credential Access', 'Lateral Movement']))::INT AS {names[8]}, (row_number() OVER (PARTITION BY host, parent, image ORDER BY n) = 1)::INT AS {names[9]}, missing AS {names[10]}, fallback AS {names[11]}{', len(t)::BIGINT AS ' + names[12] if len(names) > 12 else ''}
FROM a JOIN f2 USING (n) JOIN p USING (n)""".replace("list_distinct_ordered(event_type, " + second + ")", f"CASE WHEN event_type = {second} THEN [event_type] ELSE [event_type, {second}] END").replace(f"list_distinct_ordered({of('event_type')}, {of(second)})", f"CASE WHEN {of('event_type')} = {of(second)} THEN [{of('event_type')}] ELSE [{of('event_type')}, {of(second)}] END")


def _own_alerts(spark, sf_dir):
    return causal.guarded(_security_alerts(table(spark, sf_dir, "events")).where("node != 'collector'"), ["collector"])


@query(_features_sql("aggregate"))
def alert_features(spark, sf_dir):
    """All features of each alert, all techniques read."""
    return causal.features(_own_alerts(spark, sf_dir), "aggregate")


@query(_features_sql("primary_plus_count"))
def alert_features_primary(spark, sf_dir):
    """All features of each alert, the first technique read and all kept."""
    return causal.features(_own_alerts(spark, sf_dir), "primary_plus_count")


@query(_features_sql("aggregate"))
def stream_alert_features(spark, sf_dir):
    """The same features of the event stream, from keyed state in order of event time."""
    return causal_stream.replayed(spark, f"{sf_dir}/events.parquet", lambda rows: _security_alerts(rows).where("node != 'collector' OR event_id IS NULL"), excluded=["collector"])


@query()
def out_of_fold_scores(spark, sf_dir):
    """Scores of each fold of the alerts by a model of the folds before, tested against plain fits."""
    rows = causal.features(_own_alerts(spark, sf_dir), "aggregate").join(table(spark, sf_dir, "events").select("event_id", "ts", (F.col("value") >= 50).cast("int").alias("label")), "event_id")
    # folds read their rows twice, for the sizes of days and for the places in them
    rows = cut(rows)
    rows = routing.expanding_folds(rows, F.to_date("ts"), ["ts", "event_id"], 4)
    return out_of_fold.out_of_fold_scores(rows, list(causal.FEATURES), 4).select("event_id", "fold", F.round("score", 6).alias("score"))


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'what of ' || event_type || '?' AS question, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'user ' || user_id END AS entity, '' AS relation_hint, 'audit' AS support_kind,
 CASE user_id % 4 WHEN 0 THEN 'no supported answer exists' WHEN 1 THEN 'Snapshot_missing_as_of: ' || event_type WHEN 2 THEN 'a stale snapshot' ELSE 'not known' END AS reason, 'events' AS source, user_id % 4 IN (1, 2) OR event_type = 'signup' AS temporal_mismatch FROM events WHERE event_type IN ('error', 'signup')""")
def audit_log_stream(spark, sf_dir):
    """Audit events of the event stream, appended by a stream and read back from its log."""
    folder, path = shared_path(spark, "audit"), f"{sf_dir}/events.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    rows = source.parquet(path) if whole else source.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    user = F.col("user_id")
    answers = rows.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("what of "), "event_type", F.lit("?")).alias("question"), F.when(user % 3 != 0, F.concat(F.lit(" user "), user)).alias("entity"),
        F.lit(None).cast("string").alias("relation_hint"), F.lit("audit").alias("support_kind"), F.when(F.col("event_type").isin("error", "signup"), "audit").otherwise("answer").alias("decision"),
        F.when(user % 4 == 0, " ").when(user % 4 == 1, F.concat(F.lit("Snapshot_missing_as_of: "), "event_type")).when(user % 4 == 2, "a stale snapshot").otherwise("not known").alias("answer"),
        F.when(F.col("event_type") == "signup", F.array(F.lit("temporal_mismatch"))).alias("flags"),
    )
    audit.append_stream(audit.audit_events(answers, "events"), f"{folder}/log", f"{folder}/state").awaitTermination()
    return audit.read_log(spark, f"{folder}/log")
