"""Registered queries: lookups, bridges, explanations, attachments and scores over facts of all tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.policy import hop_safe
from factloom.operators import algebra, lookups
from factloom.plans.extracted import pick
from factloom.plans.inference import RULE_FACTS, read, rule_facts
from factloom.plans.shared import query, table, view
from factloom.sources.facts import facts

_LINKS = "SELECT 'Order ' || l_orderkey AS source_page, 'part ' || l_partkey AS target, l_returnflag AS surface FROM lineitem"


@query("SELECT 'Order ' || l_orderkey AS source_page, 'part ' || l_partkey AS target FROM lineitem WHERE l_partkey = 7 AND l_returnflag = 'R'")
def context_link_lookup(spark, sf_dir):
    return lookups.lookup(read(spark, sf_dir, _LINKS), source_page=None, target="the Part 7", surface="r").select("source_page", "target")


@query("SELECT 'supplier ' || l_suppkey AS subject, 'sold' AS predicate, 'part ' || l_partkey AS object FROM lineitem WHERE l_suppkey = 3 AND l_shipdate >= DATE '1995-01-01'")
def source_fact_lookup(spark, sf_dir):
    told = read(spark, sf_dir, "SELECT 'supplier ' || l_suppkey AS subject, 'sold' AS predicate, 'part ' || l_partkey AS object, CASE WHEN l_shipdate >= DATE '1995-01-01' THEN 'Late Ledger' ELSE 'Early Ledger' END AS source_name FROM lineitem")
    return lookups.lookup(told, subject="Supplier 3", predicate="sold", source_name="the late ledger").drop("source_name")


@query(view("owned_by") + "SELECT subject, predicate, object FROM facts WHERE object = 'Customer#000000007' AND predicate = 'owned_by'")
def fact_pattern_find(spark, sf_dir):
    return lookups.lookup(facts(spark, sf_dir, "owned_by"), subject=None, predicate="owned_by", object="customer#000000007").select("subject", "predicate", "object")


_NODES = f"SELECT l_orderkey AS id, {pick('l_partkey % 8', ["'our Part ' || l_partkey", "'It'", "'the part'", "'that one'", "'Part ' || l_partkey", "'us'", "' '", "'These parts'"])} AS node FROM lineitem"


@query(f"SELECT id, node FROM ({_NODES}) WHERE trim(lower(node)) != '' AND trim(lower(node)) NOT IN {lookups.BARE} AND string_split(trim(lower(node)), ' ')[1] NOT IN {lookups.POINTING}")
def referential_nodes(spark, sf_dir):
    rows = read(spark, sf_dir, _NODES)
    return rows.where(lookups.is_named(F.col("node")))


_PLACES = f"SELECT c_custkey AS id, 'Customer ' || c_custkey AS subject, {pick('c_nationkey % 4', ["'region'", "'Nation ' || c_nationkey", "'Market'", "'Nation ' || c_nationkey"])} AS object, {pick('c_custkey % 3', ["'customer ' || c_custkey", "'Customer  ' || c_custkey", "'Customer ' || (c_custkey + 1)"])} AS page FROM customer"


@query(f"SELECT id, subject, object FROM ({_PLACES}) WHERE regexp_replace(lower(page), ' +', ' ', 'g') = lower(subject) AND lower(object) NOT IN {lookups.ABSTRACT_PLACES}")
def renderable_locations(spark, sf_dir):
    rows = read(spark, sf_dir, _PLACES)
    return rows.where(~lookups.bad_location(F.col("subject"), F.col("object"), F.col("page"))).select("id", "subject", "object")


_ALIASES = f"SELECT p_partkey AS id, p_name AS label, {pick('p_partkey % 4', ["split_part(p_name, ' ', 2)", "split_part(p_name, ' ', 1)", "'Energy'", "p_name"])} AS alias, CASE WHEN p_size > 40 THEN 'person' ELSE 'product' END AS type FROM part"


@query(f"SELECT id, alias, (lower(alias) IN {lookups.BROAD_TOPICS} OR (len(string_split(lower(label), ' ')) > 1 AND string_split(lower(label), ' ')[-1] = lower(alias) AND type != 'person'))::INT AS unsafe FROM ({_ALIASES})")
def unsafe_aliases(spark, sf_dir):
    return read(spark, sf_dir, _ALIASES).select("id", "alias", lookups.unsafe_alias(F.col("alias"), F.col("label"), F.col("type")).cast("int").alias("unsafe"))


@query("SELECT event_id, user_id FROM events WHERE user_id % 3 = 1")
def allowed_nodes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return lookups.allowed_only(events, "user_id", table(spark, sf_dir, "events").where("user_id % 3 = 1"), excluded=(-1,)).select("event_id", "user_id")


@query(view("is_a") + ", g AS (SELECT DISTINCT p_type AS class, 'g' || (length(p_type) % 2) AS grp FROM part), q AS (SELECT 'part ' || p_partkey AS subject, t.class FROM part, (SELECT min(class) AS class FROM g) t) SELECT q.subject, q.class, min(f.object) AS basis FROM q JOIN g USING (class) JOIN facts f ON f.subject = q.subject AND f.predicate = 'is_a' JOIN g h ON h.class = f.object WHERE h.grp != g.grp GROUP BY q.subject, q.class")
def negation_basis(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    groups = parts.select(F.col("p_type").alias("class")).distinct().withColumn("grp", F.concat(F.lit("g"), F.length("class") % 2))
    first = groups.agg(F.min("class").alias("class"))
    asked = parts.select(F.concat(F.lit("part "), "p_partkey").alias("subject")).join(first)
    return lookups.contradictions(facts(spark, sf_dir, "is_a"), asked, groups)


@query(f"WITH f AS ({RULE_FACTS}) SELECT subject, object AS via FROM f WHERE predicate = 'requires' AND object IN (SELECT subject FROM f WHERE predicate = 'is_a' AND object = 'ECONOMY')")
def typed_two_hop(spark, sf_dir):
    return lookups.typed_two_hop(rule_facts(spark, sf_dir), "requires", "economy")


_ASKED = "SELECT 'order ' || o_orderkey AS a, 'nation ' || (o_orderkey % 25) AS b FROM orders"
_DIRECT = "SELECT 'order ' || o_orderkey AS a, 'nation ' || c_nationkey AS b, 'customer ' || c_custkey AS via FROM orders JOIN customer ON o_custkey = c_custkey"
_SOLD = "SELECT 'order ' || l_orderkey AS a, 'nation ' || s_nationkey AS b, 'supplier ' || s_suppkey AS via FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"
_WEAK = "SELECT 'order ' || l_orderkey AS a, 'nation ' || (l_partkey % 25) AS b, 'part ' || l_partkey AS via FROM lineitem"


@query(f"WITH q AS (SELECT DISTINCT * FROM ({_ASKED})), x AS (SELECT a, b, min(via) AS v FROM ({_DIRECT}) GROUP BY ALL), y AS (SELECT a, b, min(via) AS v FROM ({_SOLD}) GROUP BY ALL), z AS (SELECT a, b, min(via) AS v FROM ({_WEAK}) GROUP BY ALL) SELECT q.a, q.b, CASE WHEN x.v IS NOT NULL THEN 'path' WHEN y.v IS NOT NULL THEN 'source_fact' WHEN z.v IS NOT NULL THEN 'weak_link' ELSE 'audit' END AS how, coalesce(x.v, y.v, z.v) AS via FROM q LEFT JOIN x USING (a, b) LEFT JOIN y USING (a, b) LEFT JOIN z USING (a, b)")
def fallback_bridge(spark, sf_dir):
    sources = (("path", _DIRECT), ("source_fact", _SOLD), ("weak_link", _WEAK))
    return lookups.fallback_bridge(read(spark, sf_dir, _ASKED), *((name, read(spark, sf_dir, sql)) for name, sql in sources))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id FROM x WHERE o_custkey % 5 != 0")
def provenance_filter(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    step = lambda s, p, o: F.struct(s.cast("string").alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object"))
    chain = F.array(step(F.concat_ws("-", "l_orderkey", "l_linenumber"), "owned_by", F.col("l_orderkey")), step(F.col("l_orderkey"), "owned_by", F.col("o_custkey")))
    inferred = joined.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), chain.alias("chain"))
    removed = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("subject"), F.lit("owned_by").alias("predicate"), F.col("o_custkey").cast("string").alias("object"))
    return lookups.without_facts(inferred, removed).select("id").distinct()


@query(view("owned_by", "located_in") + ", e AS (SELECT subject AS focal, 1 AS s, 0 AS o FROM facts UNION ALL SELECT object, 0, 1 FROM facts) SELECT focal, sum(s)::BIGINT AS n_as_subject, sum(o)::BIGINT AS n_as_object FROM e WHERE focal IN (SELECT c_name FROM customer WHERE c_custkey % 3 = 0) GROUP BY focal")
def existence_removal(spark, sf_dir):
    focal = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("focal"))
    return lookups.conferred(facts(spark, sf_dir, "owned_by", "located_in"), focal)


_GOES = """SELECT 'supplier ' || s_suppkey AS subject, 'enables' AS predicate, 'supplier ' || (s_suppkey * 3 + 1) AS object FROM supplier UNION ALL SELECT 'supplier ' || s_suppkey, 'uses', 'supplier ' || (s_suppkey + 7) FROM supplier
 UNION ALL SELECT 'supplier ' || s_suppkey, 'knows', 'supplier ' || (s_suppkey + 15) FROM supplier UNION ALL SELECT 'supplier ' || s_suppkey, 'knows', 'supplier ' || (s_suppkey * 9 + 4) FROM supplier"""
_TOLD = "SELECT 'supplier ' || s_suppkey AS subject, 'enables' AS predicate, 'supplier ' || (s_suppkey * 3 + CASE WHEN s_suppkey % 5 = 0 THEN 2 ELSE 1 END) AS object FROM supplier"
_WALKED = f"""f AS ({_GOES}), q AS ({_TOLD}), st AS (SELECT DISTINCT subject AS s, object AS o FROM f WHERE predicate IN ('enables', 'uses')), bk AS (SELECT DISTINCT subject, object FROM f),
 w AS (WITH RECURSIVE w(subject, object, node, hops) AS (SELECT DISTINCT subject, object, object, 0 FROM q UNION SELECT w.subject, w.object, st.o, hops + 1 FROM w JOIN st ON w.node = st.s WHERE hops < 4 AND st.o != w.subject) SELECT * FROM w),
 h AS (SELECT w.subject, w.object, hops, min(node) AS closing FROM w JOIN bk ON bk.subject = w.subject AND bk.object = node WHERE hops > 0 AND node != w.object GROUP BY ALL), wk AS (SELECT subject, object, min(hops) AS hops, arg_min(closing, hops) AS closing FROM h GROUP BY subject, object)"""


@query(f"WITH {_WALKED} SELECT subject, object, hops::INT AS hops, closing FROM wk")
def explanatory_walk(spark, sf_dir):
    return lookups.walks(read(spark, sf_dir, _GOES), read(spark, sf_dir, _TOLD), ("enables", "uses"))


@query(f"WITH {_WALKED}, i AS (SELECT subject, 'enables' AS predicate, 'supplier ' || (CAST(substr(subject, 10) AS BIGINT) * 3 + 2) AS object FROM f WHERE predicate = 'uses' AND CAST(substr(subject, 10) AS BIGINT) % 10 = 0) SELECT q.subject, q.predicate, q.object, CASE WHEN q.object IN (SELECT object FROM f WHERE f.subject = q.subject AND f.predicate = 'enables') THEN 'direct' WHEN (q.subject, q.object) IN (SELECT subject, object FROM i) THEN 'inferred' ELSE 'absent' END AS status, CASE WHEN q.object IN (SELECT object FROM f WHERE f.subject = q.subject AND f.predicate = 'enables') THEN CASE WHEN (q.subject, q.object) IN (SELECT subject, object FROM wk) THEN 'answer' ELSE 'partial' END WHEN (q.subject, q.object) IN (SELECT subject, object FROM i) THEN 'answer' ELSE 'audit' END AS decision FROM q")
def explained_facts(spark, sf_dir):
    own, asked = read(spark, sf_dir, _GOES), read(spark, sf_dir, _TOLD)
    inferred = read(spark, sf_dir, "SELECT 'supplier ' || s_suppkey AS subject, 'enables' AS predicate, 'supplier ' || (s_suppkey * 3 + 2) AS object FROM supplier WHERE s_suppkey % 10 = 0")
    return lookups.explained(asked, own, inferred, lookups.walks(own, asked, ("enables", "uses")))


@query("WITH p AS (SELECT DISTINCT c_custkey AS child, c_nationkey + 1000000 AS parent FROM customer UNION SELECT c_nationkey + 1000000, c_custkey % 40 + 2000000 FROM customer UNION SELECT c_custkey % 40 + 2000000, c_custkey % 3 + 3000000 FROM customer), k AS (SELECT child, parent FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY parent) AS r FROM p) WHERE r <= 5), a AS (SELECT child, parent, 1 AS level FROM k WHERE child IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)), b AS (SELECT child, parent, 2 AS level FROM k WHERE child IN (SELECT parent FROM a)), c AS (SELECT child, parent, 3 AS level FROM k WHERE child IN (SELECT parent FROM b)) FROM a UNION ALL FROM b UNION ALL FROM c")
def ontology_expansion(spark, sf_dir):
    parents = read(spark, sf_dir, "SELECT c_custkey AS child, c_nationkey + 1000000 AS parent FROM customer UNION SELECT c_nationkey + 1000000, c_custkey % 40 + 2000000 FROM customer UNION SELECT c_custkey % 40 + 2000000, c_custkey % 3 + 3000000 FROM customer")
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("label"))
    return lookups.expanded(seeds, parents)


@query(view("owned_by") + "SELECT object, CASE WHEN count(*) FILTER (stability = 'semi_stable') > 0 THEN 'semi_stable_relation' ELSE 'stable_relation' END AS support_kind FROM safe GROUP BY object")
def support_kinds(spark, sf_dir):
    return lookups.support_kind(facts(spark, sf_dir, "owned_by").where(hop_safe()), "object")


@query("SELECT o_orderpriority AS relation, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'founded' WHEN o_orderpriority = '1-URGENT' THEN 'founded_by' ELSE 'owned_by' END AS coerced, count(*) AS n FROM orders GROUP BY ALL")
def coerced_relations(spark, sf_dir):
    own = table(spark, sf_dir, "orders").withColumn("_r", F.when(F.col("o_orderpriority") == "1-URGENT", "founded_by").otherwise("owned_by"))
    return own.groupBy(F.col("o_orderpriority").alias("relation"), lookups.coerced(F.col("_r"), F.col("o_orderstatus") == "F").alias("coerced")).agg(F.count("*").alias("n"))


@query(view("owned_by", "located_in") + ", s AS (SELECT a.subject, a.object FROM safe a WHERE a.predicate = 'owned_by' AND a.object IN (SELECT subject FROM safe WHERE predicate = 'located_in' AND object = 'NATION_3')) SELECT count(*) AS n FROM s")
def executed_plan(spark, sf_dir):
    plan = [algebra.Step("find", "orders", {"predicate": "owned_by"}), algebra.Step("filter_secondary", "near", {"rows": "$orders", "predicate": "located_in", "object": "nation_3"}), algebra.Step("count", "n", {"rows": "$near"})]
    return algebra.execute(plan, facts(spark, sf_dir, "owned_by", "located_in"))[1]


# --- attachment of evidence ---

_EDGES = "SELECT p_partkey AS edge_id, p_name || ' by ' || p_type AS subject, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_brand || ' ' || p_name || ' set' END AS object FROM part"
_ASKED_NODES = "SELECT DISTINCT p_name AS node FROM part WHERE p_size > 40 UNION SELECT p_type || ' ' || p_name || ' rare' FROM part WHERE p_size > 45"
_W = lambda x: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 2))"


@query(f"""WITH n AS (SELECT DISTINCT lower(node) AS node FROM ({_ASKED_NODES})), e AS (SELECT DISTINCT edge_id, lower(unnest([subject, object])) AS side FROM ({_EDGES})),
 x AS (SELECT node, edge_id, len(list_intersect({_W('node')}, {_W('side')})) AS k, len({_W('node')}) AS a, len({_W('side')}) AS b, side FROM n JOIN e ON len(list_intersect({_W('node')}, {_W('side')})) >= 2 OR node = side),
 m AS (SELECT node, edge_id, CASE WHEN node = side THEN 3 WHEN contains(' ' || side || ' ', ' ' || node || ' ') THEN 2 WHEN round(k / least(a, b), 6) >= 0.75 THEN 1 END AS r, CASE WHEN node = side THEN 1.0 ELSE round(k / least(a, b), 6) END AS ratio FROM x)
 SELECT node, edge_id, CASE max(r) WHEN 3 THEN 'exact' WHEN 2 THEN 'contained' ELSE 'soft' END AS mode, arg_max(ratio, (r, ratio)) AS ratio FROM m WHERE r IS NOT NULL GROUP BY node, edge_id""")
def soft_token_join(spark, sf_dir):
    return lookups.attachments(read(spark, sf_dir, _ASKED_NODES), read(spark, sf_dir, _EDGES))


@query(f"WITH n AS (SELECT DISTINCT node FROM ({_ASKED_NODES})), p AS (SELECT edge_id, unnest({_W(chr(39).join(['subject || ', ' ', ' || object']))}) AS w FROM ({_EDGES})), a AS (SELECT node, unnest({_W('node')}) AS w FROM n), h AS (SELECT node, edge_id FROM a JOIN p USING (w) GROUP BY ALL HAVING count(*) >= 2) SELECT node, count(*) AS n_edges FROM h GROUP BY node")
def token_postings(spark, sf_dir):
    return lookups.posting_frontier(read(spark, sf_dir, _ASKED_NODES), read(spark, sf_dir, _EDGES))


_SCORED = f"SELECT l_orderkey * 10 + l_linenumber AS id, p_name || ' rare' AS question, p_name || ' by ' || p_type AS terms, p_type || ' ' || l_returnflag || 'xx' AS payload, CASE WHEN l_linenumber > 3 THEN p_type ELSE 'none' END AS covered, CASE l_returnflag WHEN 'R' THEN 'stable' WHEN 'A' THEN 'semi_stable' ELSE 'volatile' END AS stability, CASE l_linestatus WHEN 'O' THEN 'low' ELSE 'medium' END AS risk, l_linenumber % 3 AS n_sources, {pick('l_suppkey % 3', ["'exact'", "'contained'", "'soft'"])} AS mode FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(f"""WITH s AS (SELECT *, {_W('question')} AS q, {_W('terms')} AS t, {_W('payload')} AS p, {_W('covered')} AS c FROM ({_SCORED})), g AS (SELECT *, len(list_filter(p, lambda x: NOT list_contains(c, x))) / greatest(len(p), 1) AS gain FROM s)
 SELECT id, round(0.25 * CASE WHEN len(q) > 0 THEN least(1.0, len(list_intersect(q, t)) / greatest(least(len(q), len(t)), 1)) ELSE 0.0 END + 0.20 * least(1.0, 0.40 + CASE stability WHEN 'stable' THEN 0.30 WHEN 'semi_stable' THEN 0.20 ELSE 0.05 END + CASE risk WHEN 'low' THEN 0.30 ELSE 0.15 END) + 0.10 * CASE WHEN n_sources > 1 THEN 1.0 ELSE 0.5 END
 + 0.20 * CASE mode WHEN 'exact' THEN 1.0 WHEN 'contained' THEN 0.75 ELSE 0.55 END + 0.25 * gain + 0.10 - 0.25 * (1.0 - gain) - 0.50 * CASE mode WHEN 'exact' THEN 0.0 WHEN 'contained' THEN 0.15 ELSE 0.30 END, 6)::DOUBLE AS score FROM g""")
def evidence_scores(spark, sf_dir):
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " "), lambda w: F.length(w) > 2))
    own = read(spark, sf_dir, _SCORED)
    own = own.withColumns({c: words(F.col(c)) for c in ("question", "terms", "payload", "covered")})
    score = lookups.candidate_score(*(F.col(c) for c in ("question", "terms", "payload", "covered", "stability", "risk", "n_sources", "mode")))
    return own.select("id", score.alias("score"))
