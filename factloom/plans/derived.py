"""More registered queries: joins of facts, rules, activation, yield reports, validation and stateful folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.policy import hop_safe
from factloom.operators import activation, events, joins, routing, rules, text
from factloom.plans.shared import ALERTS, REASON, TOKENS, query, table, view
from factloom.sources.facts import facts
from factloom.streaming import folds

# --- joins ---

_SURFACES = "SELECT p_name AS surface FROM part UNION SELECT upper(p_name) FROM part UNION SELECT p_type FROM part UNION SELECT 'Part ' || p_partkey FROM part"
_NAMES = " UNION ALL ".join(f"SELECT p_partkey AS ord, {how} AS how, {key} AS key FROM part" for how, key in enumerate(("p_name", "'part ' || p_partkey", "lower(p_name)", "'part ' || p_partkey", "lower(p_type)"), 1))


@query(f"WITH a AS ({_SURFACES}), n AS ({_NAMES}), h AS (SELECT surface, ord AS entity_id, how::BIGINT AS how, row_number() OVER (PARTITION BY surface ORDER BY how, ord) AS k FROM a JOIN n ON key = CASE WHEN how <= 2 THEN surface ELSE lower(surface) END) SELECT surface, entity_id, how FROM h WHERE k = 1")
def entity_resolution_cascade(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    alias = F.concat(F.lit("part "), "p_partkey")
    known = parts.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("label"), F.array(alias).alias("aliases"), F.col("p_type").alias("page"))
    return joins.resolve(spark.sql(_SURFACES.replace("FROM part", "FROM {part}"), part=parts), known)


_ORDER_NATIONS = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || o_orderkey ELSE n_name END AS a, CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE 'order ' || o_orderkey END AS c FROM orders JOIN nation ON n_nationkey = o_custkey % 25"


@query(view("owned_by", "located_in") + f", p AS (SELECT DISTINCT * FROM ({_ORDER_NATIONS})), w AS (SELECT a, c, 'forward' AS direction, a AS s, c AS e FROM p UNION ALL SELECT a, c, 'reverse', c, a FROM p), r AS (SELECT w.a, w.c, w.direction, CASE WHEN ({REASON.replace('predicate', 'x.predicate').replace('temporal_class', 'x.temporal_class').replace('as_of =', 'x.as_of =').replace('as_of !', 'x.as_of !').replace('stability', 'x.stability').replace('risk =', 'x.risk =')}) IS NULL THEN 'answer' ELSE 'blocked' END AS status, x.object AS via, row_number() OVER (PARTITION BY w.a, w.c ORDER BY w.direction, x.ord, y.ord) AS k FROM w JOIN facts x ON x.subject = w.s JOIN facts y ON y.subject = x.object AND y.object = w.e) SELECT p.a, p.c, direction, coalesce(status, 'audit') AS status, via FROM p LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON p.a = r.a AND p.c = r.c")
def connection_forward_reverse(spark, sf_dir):
    sql = _ORDER_NATIONS.replace("FROM orders JOIN nation", "FROM {orders} JOIN {nation}")
    pairs = spark.sql(sql, orders=table(spark, sf_dir, "orders"), nation=table(spark, sf_dir, "nation"))
    return joins.connections(facts(spark, sf_dir, "owned_by", "located_in"), pairs)


@query(view("owned_by", "located_in", "part_of") + "SELECT DISTINCT a.subject, b.object FROM safe a JOIN safe b ON a.object = b.subject WHERE a.object = 'NATION_3'")
def through_node(spark, sf_dir):
    return joins.through(facts(spark, sf_dir, "owned_by", "located_in", "part_of"), "nation_3")


_PLACES = "SELECT c_name AS subject, r_name AS object FROM customer JOIN region ON r_regionkey = c_custkey % 5 UNION SELECT c_name, n_name FROM customer JOIN nation ON n_nationkey = c_custkey % 25"


@query(view("located_in", "part_of") + f", p AS ({_PLACES}), e AS (SELECT subject AS x, object AS y, ord FROM facts UNION ALL SELECT object, subject, ord FROM facts), m AS (SELECT subject, object, arg_min(a.y, (a.ord, a.y)) AS bridge FROM p JOIN e a ON a.x = subject JOIN e b ON b.x = a.y AND b.y = object WHERE a.y != object GROUP BY ALL), d AS (SELECT DISTINCT subject, object FROM p JOIN e ON x = subject AND y = object) SELECT p.subject, p.object, CASE WHEN d.subject IS NOT NULL THEN 'direct' WHEN bridge IS NOT NULL THEN 'speculative' ELSE 'audit' END AS status, CASE WHEN d.subject IS NULL THEN bridge END AS bridge FROM p LEFT JOIN d ON p.subject = d.subject AND p.object = d.object LEFT JOIN m ON p.subject = m.subject AND p.object = m.object")
def abduction_bridge(spark, sf_dir):
    named = {t: table(spark, sf_dir, t) for t in ("customer", "region", "nation")}
    sql = _PLACES
    for t in named:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return joins.bridges(facts(spark, sf_dir, "located_in", "part_of"), spark.sql(sql, **named))


@query(view("is_a", "published_by") + "SELECT DISTINCT p.a, p.b, x.predicate, x.object FROM (SELECT 'part ' || p_partkey AS a, 'part ' || (p_partkey + 1) AS b FROM part) p JOIN safe x ON x.subject = p.a JOIN safe y ON y.subject = p.b AND x.predicate = y.predicate AND x.object = y.object")
def comparative_intersection(spark, sf_dir):
    name = lambda k: F.concat(F.lit("part "), k)
    pairs = table(spark, sf_dir, "part").select(name(F.col("p_partkey")).alias("a"), name(F.col("p_partkey") + 1).alias("b"))
    return joins.shared_facts(facts(spark, sf_dir, "is_a", "published_by"), pairs)


@query("SELECT object, count(*) AS n FROM (SELECT c_name AS subject, n_name AS object FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY object")
def inverse_merge(spark, sf_dir):
    own = facts(spark, sf_dir, "located_in").select("ord", "subject", "predicate", "object")
    turned = F.col("ord") >= 1_000_000_000
    mixed = own.where(~turned).unionByName(own.where(turned).select("ord", F.col("object").alias("subject"), F.lit("hosts").alias("predicate"), F.col("subject").alias("object")))
    return joins.with_inverse(mixed, "located_in", "hosts").groupBy("object").agg(F.count("*").alias("n"))


_CANDIDATES = "SELECT l_orderkey * 10 + l_linenumber AS ord, 'supplier ' || l_suppkey AS subject, 'produces' AS predicate, 'part ' || l_partkey AS object FROM lineitem WHERE l_linenumber % 2 = 1"
_BASE = "SELECT CASE WHEN l_linenumber > 3 THEN 'Supplier ' || l_suppkey ELSE 'part ' || l_partkey END AS subject, CASE WHEN l_linenumber > 3 THEN 'produces' ELSE 'produced_by' END AS predicate, CASE WHEN l_linenumber > 3 THEN 'part ' || l_partkey ELSE 'supplier ' || l_suppkey END AS object FROM lineitem WHERE l_linenumber % 2 = 0"


@query(f"WITH c AS ({_CANDIDATES}), b AS (SELECT 'supplier ' || l_suppkey AS subject, 'part ' || l_partkey AS object FROM lineitem WHERE l_linenumber % 2 = 0) SELECT min(ord) AS ord, subject, object FROM c WHERE (subject, object) NOT IN (FROM b) GROUP BY subject, object")
def delta_anti_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    read = lambda sql: spark.sql(sql.replace("FROM lineitem", "FROM {lines}"), lines=lines)
    return joins.new_items(read(_CANDIDATES), read(_BASE), {"produced_by": "produces"}).select("ord", "subject", "object")


@query("WITH k AS (SELECT l_partkey, min(l_returnflag) AS known FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), r AS (SELECT l_orderkey, known, l_returnflag FROM lineitem LEFT JOIN k USING (l_partkey) WHERE l_linenumber > 1), bad AS (SELECT DISTINCT l_orderkey FROM r WHERE known != l_returnflag) SELECT l_orderkey AS source, CASE WHEN known != l_returnflag THEN 'conflict' WHEN l_orderkey IN (FROM bad) THEN 'tainted' WHEN known IS NOT NULL THEN 'duplicate' ELSE 'new' END AS status, count(*) AS n FROM r GROUP BY ALL")
def tainted_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("subject"), F.lit("returned_as").alias("predicate"), F.col("l_returnflag").alias("object"), "l_linenumber")
    accepted = lines.where("l_linenumber = 1").groupBy("subject", "predicate").agg(F.min("object").alias("object"))
    out = joins.classified_delta(lines.where("l_linenumber > 1").drop("l_linenumber"), accepted)
    return out.groupBy("source", "status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, coalesce(first_event_id, -1) AS first_event_id FROM orders LEFT JOIN (SELECT user_id, min(event_id) AS first_event_id FROM events GROUP BY user_id) ON o_custkey = user_id")
def first_fetch_attribution(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return joins.first_attribution(orders, table(spark, sf_dir, "events"), "user_id", "event_id").select("o_orderkey", F.coalesce("first_event_id", F.lit(-1)).alias("first_event_id"))


@query(view("part_of", "located_in", "owned_by") + ", m AS (SELECT n_name AS e FROM nation WHERE n_regionkey = 1), n AS (SELECT object AS e FROM safe WHERE subject IN (FROM m) UNION SELECT subject FROM safe WHERE object IN (FROM m)), k AS (SELECT e FROM n WHERE e NOT IN (FROM m)) SELECT DISTINCT subject, predicate, object FROM safe WHERE (subject IN (FROM k) OR object IN (FROM k)) AND subject NOT IN (FROM m) AND object NOT IN (FROM m)")
def one_hop_context(spark, sf_dir):
    matched = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("entity"))
    return joins.one_hop(facts(spark, sf_dir, "part_of", "located_in", "owned_by"), matched)


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45) GROUP BY l_orderkey")
def heldout_disjointness(spark, sf_dir):
    seen = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    return joins.clean_groups(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), seen, "l_orderkey", "l_partkey")


@query("SELECT p_brand AS subject, 'sells' AS predicate, p_name AS canonical, count(DISTINCT p_size > 25) AS n_forms, count(*) AS n, min(CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END) AS kept FROM part GROUP BY p_brand, p_name HAVING count(DISTINCT p_size > 25) > 1")
def alias_duplicates(spark, sf_dir):
    form = F.when(F.col("p_size") > 25, F.upper("p_name")).otherwise(F.col("p_name"))
    return joins.alias_forms(table(spark, sf_dir, "part").select(F.col("p_brand").alias("subject"), F.lit("sells").alias("predicate"), form.alias("object")))


@query(view("owned_by", "located_in", "part_of") + "SELECT * FROM (SELECT subject, predicate, object, row_number() OVER (PARTITION BY object, predicate ORDER BY ord) AS rank FROM safe) WHERE rank <= 3")
def neighbourhood_selection(spark, sf_dir):
    own = facts(spark, sf_dir, "owned_by", "located_in", "part_of").where(hop_safe())
    return joins.top_rows(own, ["object", "predicate"], [F.col("ord")], 3).select("subject", "predicate", "object", "rank")


@query(view("is_a") + "SELECT DISTINCT object FROM facts WHERE object NOT IN (SELECT subject FROM facts)")
def empty_class_labels(spark, sf_dir):
    own = facts(spark, sf_dir, "is_a")
    return own.select("object").distinct().join(own.select(F.col("subject").alias("object")), "object", "left_anti")


# --- rules ---

_RULE_FACTS = """SELECT 'line ' || l_orderkey || '-' || l_linenumber AS subject, 'owned_by' AS predicate, 'order ' || l_orderkey AS object, 'stable' AS stability FROM lineitem
 UNION ALL SELECT 'order ' || o_orderkey, 'owned_by', 'customer ' || o_custkey, CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'volatile' ELSE 'semi_stable' END FROM orders
 UNION ALL SELECT 'customer ' || o_custkey, 'enables', 'order ' || o_orderkey, 'semi_stable' FROM orders
 UNION ALL SELECT DISTINCT 'order ' || l_orderkey, 'requires', 'part ' || l_partkey, 'stable' FROM lineitem
 UNION ALL SELECT 'part ' || p_partkey, 'is_a', p_type, 'stable' FROM part
 UNION ALL SELECT DISTINCT p_type, 'uses', p_brand, 'volatile' FROM part"""
_RULES = tuple(r for r in rules.BASE_RULES if r.name in ("ownership_transitivity_v1", "causal_chain_v1", "activity_inheritance_v1"))
_LEAST = "CASE {0}.stability WHEN 'stable' THEN 1.0 WHEN 'semi_stable' THEN 0.7 ELSE 0.3 END::DOUBLE"


@query(f"WITH f AS ({_RULE_FACTS}), r AS (" + " UNION ALL ".join(f"SELECT a.subject, '{head}' AS predicate, b.object, max(least({_LEAST.format('a')}, {_LEAST.format('b')})) AS confidence, '{rule}' AS rule FROM f a JOIN f b ON a.object = b.subject WHERE a.predicate = '{p}' AND b.predicate = '{q}' AND a.subject != b.object GROUP BY a.subject, b.object" for rule, p, q, head in (("ownership_transitivity_v1", "owned_by", "owned_by", "owned_by"), ("causal_chain_v1", "enables", "requires", "indirectly_requires"), ("activity_inheritance_v1", "is_a", "uses", "uses"))) + ") SELECT * FROM r")
def rule_base_chains(spark, sf_dir):
    named = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "part")}
    sql = _RULE_FACTS
    for t in named:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return rules.infer_all(spark.sql(sql, **named), _RULES)


@query(view("located_in", "part_of", "published_by", "is_a") + ", f AS (SELECT DISTINCT subject, predicate, object FROM safe WHERE predicate != 'part_of'), k AS (SELECT subject AS object, object AS class FROM safe WHERE predicate IN ('part_of', 'is_a')), m AS (SELECT DISTINCT f.predicate, class, f.subject FROM f JOIN k USING (object)), z AS (SELECT predicate, class, count(*) AS population FROM m GROUP BY ALL), o AS (SELECT DISTINCT subject, predicate AS implied FROM f) SELECT m.predicate, m.class, implied, count(*) AS support, population, round(count(*) / population, 6) AS confidence FROM m JOIN o USING (subject) JOIN z ON z.predicate = m.predicate AND z.class = m.class WHERE implied != m.predicate GROUP BY m.predicate, m.class, implied, population HAVING count(*) >= 2 AND round(count(*) / population, 6) >= 0.5")
def pattern_cooccurrence(spark, sf_dir):
    own = facts(spark, sf_dir, "located_in", "part_of", "published_by", "is_a").where(hop_safe())
    classes = own.where("predicate IN ('part_of', 'is_a')").select(F.col("subject").alias("object"), F.col("object").alias("class")).distinct()
    return rules.cooccurrences(own.where("predicate != 'part_of'"), classes)


# --- activation ---

_EDGES = f"WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations), t AS (SELECT {TOKENS.format('line')} AS w FROM l), p AS (SELECT w, k, unnest([1, 2, 3, 4]) AS lag FROM (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM t)), q AS (SELECT least(w[k], w[k + lag]) AS a, greatest(w[k], w[k + lag]) AS b FROM p WHERE k + lag <= len(w) AND w[k] != w[k + lag]), c AS (SELECT a, b, count(*) AS weight FROM q GROUP BY a, b HAVING count(*) >= 5), e AS (SELECT a AS src, b AS dst, weight FROM c UNION ALL SELECT b, a, weight FROM c), n AS (SELECT DISTINCT src AS node FROM e), s AS (SELECT node FROM n WHERE length(node) >= 8)"


def _round(before: str, damping: float) -> str:
    return f"SELECT dst AS node, max(value * (1 - 1 / (1 + weight)) * {damping}) AS value FROM {before} JOIN e ON node = src GROUP BY dst"


def _graph(spark, sf_dir):
    pairs = text.cooccurrence(table(spark, sf_dir, "conversations"))
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))
    nodes = edges.select(F.col("src").alias("node")).distinct()
    return nodes.withColumn("value", F.lit(0.5)), edges, nodes.where(F.length("node") >= 8)


@query(_EDGES + ", v0 AS (SELECT node, 0.5::DOUBLE + CASE WHEN length(node) >= 8 THEN 3 ELSE 0 END AS value FROM n)" + "".join(f", v{k} AS (SELECT node, max(value) AS value FROM (FROM v{k - 1} UNION ALL {_round(f'v{k - 1}', '0.35::DOUBLE')}) GROUP BY node)" for k in (1, 2, 3)) + " SELECT node, round(value, 6) AS value FROM v3")
def spreading_activation(spark, sf_dir):
    nodes, edges, seeds = _graph(spark, sf_dir)
    return activation.activate(nodes, edges, seeds).select("node", F.round("value", 6).alias("value"))


@query(_EDGES + f", f0 AS (SELECT node, 4.0::DOUBLE AS value FROM s), f1 AS ({_round('f0', '0.45::DOUBLE')}), f2 AS ({_round('f1', '0.45::DOUBLE')}) SELECT node, round(max(value), 6) AS value FROM (FROM f0 UNION ALL FROM f1 UNION ALL FROM f2) GROUP BY node")
def relevant_activation(spark, sf_dir):
    nodes, edges, seeds = _graph(spark, sf_dir)
    return activation.activate_near(nodes, edges, seeds).select("node", F.round("value", 6).alias("value"))


# --- reports ---


@query("SELECT l_suppkey, l_returnflag, count(*) AS support, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey, l_linenumber) FILTER (k <= 3) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS k FROM lineitem) GROUP BY ALL")
def campaign_consolidation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    keys = ["l_suppkey", "l_returnflag"]
    few = joins.top_rows(lines, keys, [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")], 3)
    few = few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "l_orderkey"))), lambda s: s["l_orderkey"].cast("string")), ",").alias("evidence"))
    return lines.groupBy(*keys).agg(F.count("*").alias("support")).join(few, keys)


_GAP = "CASE WHEN event_type = 'error' AND value >= 100 THEN 'unsafe' WHEN event_type = 'error' THEN 'missing' WHEN value < 5 THEN 'weak' ELSE 'none' END"


@query(f"SELECT user_id, gap, count(*) AS n, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC, gap) AS rank FROM (SELECT user_id, {_GAP} AS gap FROM events) WHERE gap != 'none' GROUP BY user_id, gap")
def gap_analysis(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("user_id", F.expr(_GAP).alias("gap")).where("gap != 'none'").groupBy("user_id", "gap").agg(F.count("*").alias("n"))
    return joins.top_rows(found, ["user_id"], [F.desc("n"), F.col("gap")], 3)


@query("SELECT l_partkey, count(*) AS candidates, count(*) FILTER (l_returnflag = 'R') AS rejected, count(*) FILTER (l_returnflag != 'R' AND l_discount >= 0.08) AS quarantined, count(*) FILTER (l_returnflag != 'R' AND l_discount < 0.08) AS accepted, round(count(*) FILTER (l_returnflag != 'R' AND l_discount < 0.08) / count(*), 6) AS survival FROM lineitem GROUP BY l_partkey")
def page_survival(spark, sf_dir):
    back, risky = F.col("l_returnflag") == "R", F.col("l_discount") >= 0.08
    count = lambda c: F.count_if(c)
    out = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("candidates"), count(back).alias("rejected"), count(~back & risky).alias("quarantined"), count(~back & ~risky).alias("accepted"))
    return out.withColumn("survival", F.round(F.col("accepted") / F.col("candidates"), 6))


@query("WITH f AS (SELECT user_id, min(ts::DATE) AS day FROM events GROUP BY user_id) SELECT ts::DATE::VARCHAR AS day, count(*) AS n_events, count(DISTINCT e.user_id) FILTER (f.day = ts::DATE) AS n_new, round(count(DISTINCT e.user_id) FILTER (f.day = ts::DATE) / count(*), 6) AS yield FROM events e JOIN f USING (user_id) GROUP BY ts::DATE")
def batch_yield_trace(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("k"))
    first = rows.groupBy("user_id").agg(F.min("day").alias("first"))
    days = rows.join(first, "user_id").groupBy("day").agg(F.sum("k").alias("n_events"), F.count_if(F.col("first") == F.col("day")).alias("n_new"))
    return days.select(F.col("day").cast("string").alias("day"), "n_events", "n_new", F.round(F.col("n_new") / F.col("n_events"), 6).alias("yield"))


@query("SELECT array_to_string(list_sort(json_keys(props)), '|') AS shape, event_type, count(*) AS n FROM events GROUP BY ALL")
def payload_shapes(spark, sf_dir):
    shape = F.array_join(F.array_sort(F.json_object_keys("props")), "|")
    return table(spark, sf_dir, "events").groupBy(shape.alias("shape"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, concat_ws('|', CASE WHEN n_chars < 200 THEN 'low_score' END, CASE WHEN contains(lower(text), 'i think') OR contains(lower(text), 'in my experience') THEN 'anecdotal' END, CASE WHEN contains(text, '?') THEN 'question_like' END) AS flags FROM documents")
def quality_flags(spark, sf_dir):
    low = F.lower("text")
    flags = (F.when(F.col("n_chars") < 200, "low_score"), F.when(F.contains(low, F.lit("i think")) | F.contains(low, F.lit("in my experience")), "anecdotal"), F.when(F.contains("text", F.lit("?")), "question_like"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("|", *flags).alias("flags"))


_TITLE = "60 * (f.facts > 0)::INT + 40 * (f.facts >= 2)::INT + 8 * (c_mktsegment != 'BUILDING')::INT + least(f.facts, 50) / 50 - 50 * (f.facts = 0 AND c_acctbal < 0)::INT - 30 * (c_mktsegment = 'BUILDING')::INT"


@query(f"WITH f AS (SELECT c_custkey, c_mktsegment, c_acctbal, count(o_orderkey) FILTER (o_orderstatus = 'P') AS facts FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL), s AS (SELECT c_custkey, c_mktsegment, round({_TITLE}, 4) AS score FROM f) SELECT c_custkey, score, CASE WHEN c_mktsegment = 'BUILDING' THEN 'blocked' WHEN score >= 60 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS class FROM s")
def title_score(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("facts"))
    rows = table(spark, sf_dir, "customer").join(done, "c_custkey", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    hidden, n = F.col("c_mktsegment") == "BUILDING", F.col("facts")
    signals = ((n > 0, 60), (n >= 2, 40), (~hidden, 8), ((n == 0) & (F.col("c_acctbal") < 0), -50), (hidden, -30))
    score = sum((F.when(when, points).otherwise(0) for when, points in signals), F.least(n, F.lit(50)) / 50)
    out = rows.withColumn("score", F.round(score, 4))
    return out.select("c_custkey", "score", F.when(hidden, "blocked").when(F.col("score") >= 60, "high").when(F.col("score") >= 20, "medium").otherwise("low").alias("class"))


@query("SELECT * FROM (SELECT lang, doc_id, sha256('7:' || doc_id) AS hash, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 20")
def seeded_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.sha2(F.concat(F.lit("7:"), "doc_id"), 256).alias("hash"))
    return joins.top_rows(rows, ["lang"], [F.col("hash"), F.col("doc_id")], 20)


# --- validation on the stream ---

_SCORED = "SELECT event_id, ts, event_type, (event_type = 'error')::INT AS label, round(value / (10 + value), 3) AS score, round(json_extract_string(props, '$.k')::DOUBLE / 100, 3) AS second FROM events"
_LOWS, _HIGHS, _AT = (0.5, 0.55, 0.6, 0.65, 0.7), (0.7, 0.75, 0.8, 0.85, 0.9), 0.7


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    second = F.round(F.get_json_object("props", "$.k").cast("double") / 100, 3)
    return rows.select("event_id", "ts", "event_type", (F.col("event_type") == "error").cast("int").alias("label"), F.round(F.col("value") / (10 + F.col("value")), 3).alias("score"), second.alias("second"))


@query("WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts::DATE, ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events) SELECT event_id, (" + " + ".join(f"(pos >= floor({k} * n / 5))::BIGINT" for k in range(1, 5)) + ") AS fold FROM p")
def expanding_folds(spark, sf_dir):
    return routing.expanding_folds(table(spark, sf_dir, "events").select("event_id", "ts"), F.to_date("ts"), ["ts", "event_id"], 5).select("event_id", "fold")


_CURVE = f"WITH s AS ({_SCORED}), b AS (SELECT lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (SELECT unnest({list(_LOWS)}) AS lo), (SELECT unnest({list(_HIGHS)}) AS hi)), t AS (SELECT count(*) AS n, count(*) FILTER ((score >= {_AT})::INT != label) AS errors FROM s), c AS (SELECT lo, hi, count(*) FILTER (score >= lo AND score <= hi) AS routed, count(*) FILTER (score >= lo AND score <= hi AND (score >= {_AT})::INT != label) AS errors_captured FROM b, s GROUP BY lo, hi), k AS (SELECT lo, hi, routed, round(routed / n, 6) AS routed_share, errors_captured, round(errors_captured / errors, 6) AS error_capture FROM c, t) "


@query(_CURVE + "SELECT * FROM k")
def band_curve(spark, sf_dir):
    return routing.band_curve(_scored(spark, sf_dir), _AT, list(_LOWS), list(_HIGHS))


@query(_CURVE + "SELECT * FROM k WHERE routed_share <= 0.3 ORDER BY errors_captured DESC, routed, round(hi - lo, 9), lo LIMIT 1")
def select_band(spark, sf_dir):
    return routing.select_band(routing.band_curve(_scored(spark, sf_dir), _AT, list(_LOWS), list(_HIGHS)), 0.3)


def _routed(spark, sf_dir):
    return routing.route(_scored(spark, sf_dir).withColumnsRenamed({"score": "primary", "second": "secondary"}), 0.6, 0.8)


_ROUTED = f"WITH s AS ({_SCORED}), r AS (SELECT *, (score BETWEEN 0.6 AND 0.8)::BIGINT AS routed, CASE WHEN score BETWEEN 0.6 AND 0.8 THEN second ELSE score END AS final FROM s)"


@query(_ROUTED + " SELECT event_id, routed, final FROM r")
def confidence_route(spark, sf_dir):
    return _routed(spark, sf_dir).select("event_id", "routed", "final")


@query(_ROUTED + f", x AS (SELECT routed = 1 AS inside, label = 1 AS truth, (score >= {_AT}) = (label = 1) AS was, (final >= {_AT}) = (label = 1) AS now FROM r) SELECT count(*) FILTER (inside) AS routed, count(*) FILTER (inside AND truth) AS routed_positives, count(*) FILTER (inside AND NOT was) AS errors_inside, count(*) FILTER (NOT inside AND NOT was) AS errors_outside, count(*) FILTER (inside AND NOT was AND now) AS fixed, count(*) FILTER (inside AND was AND NOT now) AS broken, count(*) FILTER (inside AND NOT was AND now) - count(*) FILTER (inside AND was AND NOT now) AS net FROM x")
def flip_analysis(spark, sf_dir):
    return routing.flips(_routed(spark, sf_dir), _AT)


@query(f"WITH s AS ({_SCORED}), g AS (SELECT score, sum(label)::BIGINT AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT *, (sum(p) OVER w)::DOUBLE AS cp, (sum(n) OVER w)::DOUBLE AS cn FROM g WINDOW w AS (ORDER BY score DESC)) SELECT sum(n)::BIGINT AS n, sum(p)::BIGINT AS positives, round(sum((n - p) * (cp - p / 2)) / (sum(p) * (sum(n) - sum(p))), 6) AS roc_auc, round(sum(p * cp / cn) / sum(p), 6) AS average_precision FROM c")
def ranking_metrics(spark, sf_dir):
    return routing.ranking_metrics(_scored(spark, sf_dir))


@query(f"WITH s AS ({_SCORED}) SELECT event_type, count(*) AS n, count(*) FILTER (score >= {_AT}) AS flagged, round(count(*) FILTER (score >= {_AT}) / count(*), 6) AS share FROM s GROUP BY event_type")
def flagged_by_type(spark, sf_dir):
    rows = _scored(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= _AT).alias("flagged"))
    return rows.withColumn("share", F.round(F.col("flagged") / F.col("n"), 6))


@query(f"WITH s AS ({_SCORED}) SELECT event_type, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median, round(count(*) FILTER (score != 0) / count(*), 6) AS share_nonzero FROM s GROUP BY event_type")
def descriptive_stats(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.percentile("score", 0.5), 6).alias("median"), F.round(F.count_if(F.col("score") != 0) / F.count("*"), 6).alias("share_nonzero"))


@query()
def logistic_arms(spark, sf_dir):
    """Ranking metrics of two feature sets, fitted on the first days and scored on the last."""
    rows = events.time_typicality(events.frequencies(events.alerts(table(spark, sf_dir, "events"))))
    rows = events.chronological_split(rows.withColumn("label", (F.col("level") >= 50).cast("int")))
    arms = {"baseline": ["host", "band"], "with_history": ["host", "band", "freq_24h", "freq_7d", "typicality"]}
    found = []
    for arm, features in arms.items():
        scored = routing.logistic_scores(rows.where("part = 'train'"), rows.where("part = 'test'"), features)
        found.append(routing.ranking_metrics(scored).withColumn("arm", F.lit(arm)))
    return found[0].unionByName(found[1])


# --- stateful folds ---


@query(ALERTS + ", m AS (SELECT *, lag(host) OVER w AS before, lag(us) OVER w AS prior FROM a WINDOW w AS (PARTITION BY actor ORDER BY us, event_id)) SELECT event_id, host AS place, coalesce(before, -1) AS before, CASE WHEN before IS NULL THEN 'introduced' WHEN before = host THEN 'stays' WHEN us = prior THEN 'bilocation' WHEN us - prior < 60000000 THEN 'teleport' ELSE 'moves' END AS verdict FROM m")
def world_state_transitions(spark, sf_dir):
    return events.transitions(events.alerts(table(spark, sf_dir, "events")), 60).withColumn("before", F.coalesce("before", F.lit(-1)))


@query()
def sliding_limiter(spark, sf_dir):
    """At most three admitted events of a user in any hour."""
    own = events.alerts(table(spark, sf_dir, "events")).withColumn("key", F.col("actor"))
    return folds.limited(own, 3, 3600)


@query()
def dialogue_state_fold(spark, sf_dir):
    """Entities (words of nine letters or more) and topic of each conversation after each turn."""
    named = F.array_distinct(F.filter(text.tokens(F.col("text")), lambda t: F.length(t) >= 9))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").alias("confirmed"), named.alias("entities"))
    return folds.dialogue_states(turns)
