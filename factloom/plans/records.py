"""Registered queries: parsed records, definitions and membership, dialogue, sampling and planning, consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import corpus, dialogue, events, graph, joins, routing
from factloom.operators.text import PATTERNS, extracted_relations, ngrams, tokens
from factloom.plans.shared import ALERTS, TOKENS, query, table, view
from factloom.sources import records
from factloom.sources.facts import facts

# --- parsed records ---


@query("SELECT p_partkey, p_partkey::VARCHAR AS id, p_brand AS title, 'http://example.org/' || p_partkey AS url, p_name AS abstract FROM part WHERE p_partkey % 5 != 0 AND p_name != ''")
def works_from_json(spark, sf_dir):
    words = F.array_distinct(F.split("p_name", " "))
    index = F.map_from_arrays(words, F.transform(words, lambda w, k: F.array(k)))
    url = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("http://example.org/"), "p_partkey"))
    work = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("title"), url.alias("url"), index.alias("abstract_index"))
    return records.works(table(spark, sf_dir, "part").select("p_partkey", F.to_json(work).alias("payload")))


@query("WITH h AS (SELECT event_id, epoch_us(ts) AS us, 'host ' || (user_id % 5) AS host, value::INT AS level, CASE WHEN user_id % 3 != 0 THEN 'user ' || user_id END AS u, CASE WHEN user_id % 2 != 0 THEN 'source ' || user_id END AS s FROM events) SELECT event_id, us, host, level, coalesce(u, s, host) AS actor, CASE WHEN u IS NOT NULL THEN 1 WHEN s IS NOT NULL THEN 2 ELSE 3 END AS tier, (u IS NULL)::INT AS missing_subject, (u IS NULL AND s IS NULL)::INT AS host_fallback FROM h")
def hits_flattened(spark, sf_dir):
    k = F.col("user_id")
    named = lambda word, every: F.when(k % every != 0, F.concat(F.lit(f"{word} "), k))
    hit = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.struct(F.concat(F.lit("host "), k % 5).alias("name")).alias("agent"),
        F.struct(named("user", 3).alias("user"), named("source", 2).alias("srcuser")).alias("data"), F.struct(F.rint("value").cast("int").alias("level"), F.array("event_type").alias("technique")).alias("rule"),
    )
    return records.hits(table(spark, sf_dir, "events").select("event_id", F.to_json(hit).alias("payload"))).drop("techniques")


@query("SELECT s_suppkey, s_suppkey::VARCHAR AS id, s_name AS title, n_name AS authors FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def entries_from_xml(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    entry = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.array(F.struct(F.col("n_name").alias("name"))).alias("author"))
    out = records.entries(rows.select("s_suppkey", F.to_xml(entry).alias("payload")))
    return out.withColumn("authors", F.array_join("authors", ","))


# --- definitions and membership ---


@query("WITH k AS (SELECT p_partkey AS ord, 'part ' || p_partkey AS subject, p_brand || ' of ' || p_name AS definition, p_type AS page FROM part WHERE p_partkey % 3 = 0), f AS (SELECT lower(page) AS key, ord, definition FROM k QUALIFY row_number() OVER (PARTITION BY lower(page) ORDER BY ord) = 1) SELECT p_partkey AS entity_id, coalesce(f.definition, k.definition) AS definition, (CASE WHEN f.ord IS NOT NULL THEN 80 ELSE 10 END)::BIGINT AS score FROM part LEFT JOIN f ON f.key = lower(p_type) AND p_size > 10 LEFT JOIN k ON k.ord = p_partkey WHERE f.ord IS NOT NULL OR k.ord IS NOT NULL")
def definition_resolution(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    alias = F.concat(F.lit("Part "), "p_partkey")
    known = parts.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ord"), alias.alias("subject"), F.concat("p_brand", F.lit(" of "), "p_name").alias("definition"), F.col("p_type").alias("page"))
    page = F.when(F.col("p_size") > 10, F.col("p_type"))
    return joins.definitions(parts.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("label"), F.array(alias).alias("aliases"), page.alias("page")), known)


_GROUP = "CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'STANDARD') THEN 'plain' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'large' END"
_ASKED = "SELECT 'part ' || a.p_partkey AS subject, b.p_type AS class FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


@query(f"WITH g AS (SELECT DISTINCT p_type, {_GROUP} AS grp FROM part), q AS ({_ASKED}) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN own.p_type = class THEN 'yes' WHEN a.grp != b.grp THEN 'no' ELSE 'audit' END AS verdict FROM q JOIN part own ON subject = 'part ' || p_partkey JOIN g a ON a.p_type = own.p_type JOIN g b ON b.p_type = class) GROUP BY verdict")
def isa_membership(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    direct = facts(spark, sf_dir, "is_a").select("subject", "object").distinct()
    groups = parts.select(F.col("p_type").alias("class"), F.expr(_GROUP).alias("group")).distinct()
    asked = spark.sql(_ASKED.replace("part a", "{part} a").replace("part b", "{part} b"), part=parts)
    return joins.membership(asked, graph.closure(direct, 3), direct, groups).groupBy("verdict").agg(F.count("*").alias("n"))


# --- dialogue and stream ---


@query(f"WITH w AS (SELECT conv_id, turn, role, unnest(list_filter({TOKENS.format('text')}, lambda t: length(t) >= 12)) AS entity FROM conversations), e AS (SELECT conv_id, max(turn) AS fin, max(turn) FILTER (role = 'assistant') AS ans, max(turn) FILTER (role = 'user') AS que FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, entity, count(*) AS m, max(turn) AS last, arg_min(role, turn) AS first, max(turn) FILTER (role = 'assistant') AS a, max(turn) FILTER (role = 'user') AS q FROM w GROUP BY ALL), p AS (SELECT conv_id, entity, 40 * coalesce(a = ans, FALSE)::INT + 30 * coalesce(q = que, FALSE)::INT + 15 * (first = 'user')::INT + greatest(-60, -12 * (fin - last)) + 3 * least(m, 5) AS salience FROM s JOIN e USING (conv_id)), k AS (SELECT *, lead(salience) OVER (PARTITION BY conv_id ORDER BY salience DESC, entity) AS nxt, row_number() OVER (PARTITION BY conv_id ORDER BY salience DESC, entity) AS r FROM p) SELECT conv_id, entity, salience, CASE WHEN nxt IS NULL OR salience - nxt >= 25 THEN 'resolved' ELSE 'ambiguous' END AS decision FROM k WHERE r = 1")
def singular_reference(spark, sf_dir):
    words = F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 12)
    seen = dialogue.activations(table(spark, sf_dir, "conversations"), words)
    return dialogue.singular(seen.withColumn("salience", dialogue.salience()))


_PEERS = "(count(*) OVER (PARTITION BY actor, t ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY actor, t, us) + row_number() OVER (PARTITION BY actor, t, us ORDER BY event_id) - 1)"


@query(ALERTS + f", x AS (SELECT event_id, us, actor, unnest([technique, 'host ' || host]) AS t FROM a), y AS (SELECT event_id, {_PEERS} AS f, (row_number() OVER (PARTITION BY actor, t ORDER BY us, event_id) = 1)::INT AS n FROM x) SELECT event_id, count(*) AS n_techniques, min(f) AS freq_7d, max(n) AS novel FROM y GROUP BY event_id")
def multi_technique_modes(spark, sf_dir):
    rows = events.alerts(table(spark, sf_dir, "events"))
    return events.multi_technique(rows.withColumn("techniques", F.array("technique", F.concat(F.lit("host "), "host"))))


@query(ALERTS + "SELECT CASE host WHEN 0 THEN 'excluded' WHEN 1 THEN 'allowed' WHEN 2 THEN 'allowed' ELSE 'unrecognised' END AS kind, host, count(*) AS n FROM a GROUP BY ALL")
def node_audit(spark, sf_dir):
    kind = F.when(F.col("host") == 0, "excluded").when(F.col("host").isin(1, 2), "allowed").otherwise("unrecognised")
    return events.alerts(table(spark, sf_dir, "events")).groupBy(kind.alias("kind"), "host").agg(F.count("*").alias("n"))


# --- sampling, planning, consolidation ---


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.n IS NULL THEN 'missing' WHEN d.n IS NULL THEN 'extra' WHEN d.n > 1 OR l.n > 1 THEN 'repeated' ELSE 'matched' END AS status FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY doc_id) d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def dataset_result_join(spark, sf_dir):
    return joins.one_to_one(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(view() + "SELECT predicate, row_number() OVER (PARTITION BY predicate ORDER BY sha256('11:' || ord)) AS rank, ord FROM facts QUALIFY rank <= 20")
def stratified_cases(spark, sf_dir):
    key = F.sha2(F.encode(F.concat(F.lit("11:"), "ord"), "UTF-8"), 256)
    return joins.top_rows(facts(spark, sf_dir).select("predicate", "ord", key.alias("_key")), ["predicate"], [F.col("_key")], 20).select("predicate", "rank", "ord")


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1) // 50 AS batch_index, (c_custkey % 7 = 0)::INT AS already_fetched FROM customer WHERE c_acctbal IS NOT NULL")
def batch_planning(spark, sf_dir):
    frontier = table(spark, sf_dir, "customer").where("c_acctbal IS NOT NULL").select("c_custkey", (-F.col("c_acctbal")).alias("_w"))
    placed = routing.positions(frontier, F.floor(F.col("_w") / 100), ["_w", "c_custkey"])
    return placed.select("c_custkey", F.floor(F.col("pos") / 50).alias("batch_index"), (F.col("c_custkey") % 7 == 0).cast("int").alias("already_fetched"))


_STEPS = f"SELECT split_part(g, ' ', 1) AS src, split_part(g, ' ', 2) AS dst, count(*) AS weight FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT {TOKENS.format('text')} AS w FROM conversations)) GROUP BY ALL"


@query(f"WITH e AS ({_STEPS}), s AS (SELECT *, sum(weight) OVER (PARTITION BY src ORDER BY weight DESC, dst ROWS UNBOUNDED PRECEDING) AS upto, sum(weight) OVER (PARTITION BY src) AS whole, ('0x' || substr(sha256('5:' || src), 1, 12))::BIGINT AS drawn FROM e) SELECT src, dst FROM s WHERE drawn % whole < upto AND drawn % whole >= upto - weight")
def seeded_weighted_pick(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").select(F.explode(ngrams(F.col("text"), 2)).alias("g")).groupBy("g").agg(F.count("*").alias("weight"))
    return joins.weighted_pick(steps.select(F.element_at(F.split("g", " "), 1).alias("src"), F.element_at(F.split("g", " "), 2).alias("dst"), "weight"), "5")


_FOUND = "WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents), r AS (" + " UNION ".join(f"SELECT doc_id, '{name}' AS predicate, regexp_extract(line, '{pattern}', 1) AS object FROM l" for name, pattern in PATTERNS) + ")"
_CONFIDENCE = "CASE WHEN support >= 10 AND sources >= 3 THEN 'high' WHEN support >= 2 THEN 'medium' ELSE 'low' END"


@query(_FOUND + f" SELECT predicate, object, support, sources, {_CONFIDENCE} AS confidence FROM (SELECT predicate, object, count(DISTINCT doc_id) AS support, count(DISTINCT source) AS sources FROM r JOIN documents USING (doc_id) WHERE object != '' GROUP BY ALL)")
def pattern_consolidation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = extracted_relations(docs).join(docs.select("doc_id", "source").distinct(), "doc_id")
    per = found.groupBy("predicate", "object", "source").agg(F.count_distinct("doc_id").alias("k"))
    out = per.groupBy("predicate", "object").agg(F.sum("k").alias("support"), F.count("source").alias("sources"))
    return out.withColumn("confidence", F.expr(_CONFIDENCE))


@query("WITH k AS (SELECT c_mktsegment || ' ' || c_nationkey AS title, c_custkey FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ALL HAVING count(*) FILTER (o_orderstatus = 'F') > 0 AND count(*) FILTER (o_orderstatus = 'O') > 0) SELECT title, arg_min(c_custkey, sha256(c_custkey::VARCHAR)) AS c_custkey FROM k GROUP BY title")
def density_cohort(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_nationkey").alias("title"))
    rows = own.join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joins.cohort(rows, "c_custkey", "o_orderstatus", "title", ["F", "O"])


@query(view("is_a", "located_in") + ", r AS (SELECT DISTINCT predicate, object, subject FROM facts), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY predicate, object ORDER BY subject) <= 5), e AS (SELECT predicate, object, string_agg(subject, '|' ORDER BY subject) AS evidence FROM k GROUP BY ALL) SELECT predicate, object, n AS support, evidence FROM (SELECT predicate, object, count(*) AS n FROM facts GROUP BY ALL) JOIN e USING (predicate, object)")
def capped_evidence(spark, sf_dir):
    return joins.capped_evidence(facts(spark, sf_dir, "is_a", "located_in"), ["predicate", "object"], 5)


_KEYS = f"SELECT w[1] AS key, TIMESTAMP '2024-01-01' + (item_id % 14) * INTERVAL 1 DAY AS fetched FROM (SELECT item_id, {TOKENS.format('text')} AS w FROM benchmark) WHERE len(w) > 0"


@query(f"WITH k AS (SELECT DISTINCT key FROM ({_KEYS}) WHERE fetched + INTERVAL 168 HOUR > TIMESTAMP '2024-01-14' AND length(key) >= 5), g AS (SELECT conv_id * 1000 + turn AS question_id, unnest({TOKENS.format('text')}) AS key FROM conversations), b AS (SELECT question_id, key FROM g JOIN k USING (key) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY length(key) DESC, key) = 1) SELECT DISTINCT conv_id * 1000 + turn AS question_id, key FROM conversations LEFT JOIN b ON b.question_id = conv_id * 1000 + turn")
def cache_lookup(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select("item_id", F.try_element_at(tokens(F.col("text")), F.lit(1)).alias("key")).where("key IS NOT NULL")
    known = own.select("key", F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(item_id % 14)").alias("fetched"))
    asked = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text")
    return corpus.cached(asked, known, "2024-01-14")
