"""Registered queries: scalar functions over whole columns, retrieval, pattern events, baselines and slices of an event stream."""

from __future__ import annotations


from pyspark.sql import functions as F

from factloom.functions import words
from factloom.operators import events, measures, retrieval
from factloom.plans.extracted import pick
from factloom.plans.inference import read
from factloom.plans.shared import ALERTS, TOKENS, query, table

# --- scalar functions ---

_KEY = lambda x: f"trim(regexp_replace(lower({x}), '[ \\t\\n\\r]+', ' ', 'g'))"


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, CASE WHEN length(p_name) <= 9 THEN p_name ELSE regexp_replace(substr(p_name, 1, 6), '\\s+\\S*$', '') || '...' END AS clipped, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN p_name || ' and ' || p_brand ELSE p_name || ', ' || p_brand || ', and ' || p_type END AS listed FROM part")
def slugs_clips_lists(spark, sf_dir):
    items = F.slice(F.array("p_name", "p_brand", "p_type"), F.lit(1), F.col("p_partkey").cast("int") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", words.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), words.clip(F.col("p_name"), 9).alias("clipped"), words.listed(items).alias("listed"))


_VERBS = f"SELECT l_orderkey * 10 + l_linenumber AS id, {pick('l_partkey % 7', ["'develops'", "'publishes'", "'teaches'", "'boxes'", "'passes'", "'pass'", "'make'"])} AS verb, {pick('l_suppkey % 4', ["'Rockets'", "'gas'", "'bus'", "'Nations'"])} AS noun FROM lineitem"


@query(f"SELECT id, CASE WHEN regexp_matches(verb, '(shes|ches|xes|sses)$') THEN substr(verb, 1, length(verb) - 2) WHEN ends_with(verb, 's') AND NOT ends_with(verb, 'ss') THEN substr(verb, 1, length(verb) - 1) ELSE verb END AS verb, CASE WHEN length(noun) > 3 AND ends_with(noun, 's') THEN lower(substr(noun, 1, length(noun) - 1)) ELSE lower(noun) END AS noun FROM ({_VERBS})")
def morphology(spark, sf_dir):
    return read(spark, sf_dir, _VERBS).select("id", words.base_verb(F.col("verb")).alias("verb"), words.singular(F.col("noun")).alias("noun"))


@query("WITH w AS (SELECT p_partkey, p_name AS word FROM part) SELECT p_partkey, length(regexp_replace(lower(word), '[^aeiouy]', '', 'g')) AS syllables, CASE WHEN regexp_extract(lower(word), '([aeiouy][^aeiouy]*[aeiouy][^aeiouy]*)$', 1) != '' THEN regexp_extract(lower(word), '([aeiouy][^aeiouy]*[aeiouy][^aeiouy]*)$', 1) WHEN regexp_extract(lower(word), '([aeiouy][^aeiouy]*)$', 1) != '' THEN regexp_extract(lower(word), '([aeiouy][^aeiouy]*)$', 1) ELSE lower(word) END AS rhyme FROM w")
def syllables_and_rhymes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", words.syllables(F.col("p_name")).alias("syllables"), words.rhyme_key(F.col("p_name")).alias("rhyme"))


@query("SELECT rhyme, count(*) AS n FROM (SELECT DISTINCT p_name, regexp_extract(lower(p_name), '([aeiouy][^aeiouy]*[aeiouy][^aeiouy]*)$', 1) AS rhyme FROM part) WHERE rhyme != '' GROUP BY rhyme HAVING count(*) >= 2")
def rhyme_groups(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_name").distinct().select(words.rhyme_key(F.col("p_name")).alias("rhyme"))
    return own.groupBy("rhyme").agg(F.count("*").alias("n")).where("n >= 2")


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://(?:www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS permalink FROM pages WHERE url IS NOT NULL")
def permalinks(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", words.permalink(F.col("url")).alias("permalink"))


_USERS = f"SELECT event_id, {pick('user_id % 4', ["'CORP~user' || user_id", "'SYSTEM'", "'~u' || user_id", "'CORP~'"])} AS raw FROM events"


@query(f"WITH u AS (SELECT event_id, replace(raw, '~', chr(92)) AS raw FROM ({_USERS})) SELECT event_id, coalesce(nullif(CASE WHEN contains(raw, chr(92)) THEN split_part(raw, chr(92), 2) ELSE raw END, ''), '-') AS user, coalesce(nullif(CASE WHEN contains(raw, chr(92)) THEN split_part(raw, chr(92), 1) ELSE '' END, ''), '-') AS domain FROM u")
def domain_users(spark, sf_dir):
    own = read(spark, sf_dir, _USERS, "events").select("event_id", words.domain_user(F.translate("raw", "~", "\\")).alias("u"))
    return own.select("event_id", F.coalesce("u.user", F.lit("-")).alias("user"), F.coalesce("u.domain", F.lit("-")).alias("domain"))


_DEFINED = f"SELECT l_orderkey * 10 + l_linenumber AS id, {pick('l_partkey % 6', ["'a private company in a city'", "'An American singer and founder'", "'the largest city of a region'", "'a cold widget'", "'a war'", "''"])} AS definition FROM lineitem"


@query(f"SELECT id, CASE WHEN definition = '' THEN 'other' " + " ".join(f"WHEN regexp_matches(definition, '{p}') THEN '{t}'" for t, p in words.TYPE_RULES) + f" ELSE 'other' END AS type FROM ({_DEFINED})")
def entity_types_from_text(spark, sf_dir):
    return read(spark, sf_dir, _DEFINED).select("id", words.entity_type(F.col("definition")).alias("type"))


# Keywords of questions and the relations they name; other keywords come as a parameter.
INTENTS = {
    "founded by": "founded_by", "founders of": "founded_by", "founder of": "founded_by", "founded": "founded_by", "established": "founded_by", "set up": "founded_by", "created by": "created_by", "owned by": "owned_by",
    "who owns": "owned_by", "subsidiary of": "subsidiary_of", "headquartered": "headquartered_in", "head office": "headquartered_in", "headquarters": "headquartered_in", "located": "located_in", "where is": "located_in",
    "developed by": "developed_by", "develops": "develops", "makes": "develops", "manufactures": "manufactures", "produces": "produces", "published by": "published_by", "ceo": "leader_of", "head": "leader_of", "leads": "leader_of",
    "part of": "part_of", "used for": "used_for", "how does": "works_by", "works by": "works_by", "known for": "known_for", "valued at": "valued_at",
}
_QUESTIONS = f"SELECT l_orderkey * 10 + l_linenumber AS question_id, {pick('l_partkey % 8', ["'Who founded part ' || l_partkey || ', and where is its head office?'", "'Who is the head of it, founded by whom?'", "'Where is it located and headquartered?'", "'What is it used for'", "'Is it owned by a ceo'", "'How does it work, what makes it'", "'makeshift heads'", "'Part of what, known for what, part of whom'"])} AS question FROM lineitem"


def _intent_sql() -> str:
    ordered = sorted(INTENTS, key=lambda k: (-len(k), k))
    left, found = _KEY("question"), []
    ctes = [f"i0 AS (SELECT question_id, {left} AS rest, []::VARCHAR[] AS f FROM ({_QUESTIONS}))"]
    for n, k in enumerate(ordered, 1):
        p = f"(^|[^a-z0-9_]){k}($|[^a-z0-9_])"
        ctes.append(f"i{n} AS (SELECT question_id, regexp_replace(rest, '{p}', '\\1#\\2', 'g') AS rest, CASE WHEN regexp_matches(rest, '{p}') THEN list_append(f, '{INTENTS[k]}') ELSE f END AS f FROM i{n - 1})")
    return f"WITH {', '.join(ctes)}, r AS (SELECT question_id, list_sort(list_distinct(f)) AS f FROM i{len(ordered)}) SELECT question_id, array_to_string(list_filter(f, lambda x: x != 'located_in' OR NOT list_contains(f, 'headquartered_in')), ',') AS relations FROM r"


@query(_intent_sql())
def relation_intents(spark, sf_dir):
    return read(spark, sf_dir, _QUESTIONS).select("question_id", F.array_join(words.intents(F.col("question"), INTENTS), ",").alias("relations"))


@query("SELECT event_id, CASE WHEN value / 200 >= 0.85 THEN 'high' WHEN value / 200 >= 0.6 THEN 'medium' ELSE 'low' END AS word FROM events")
def confidence_words(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", words.confidence_word(F.col("value") / 200).alias("word"))


@query("WITH c AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'snapshot' WHEN l_returnflag = 'A' THEN 'aggregate' WHEN l_linestatus = 'O' THEN 'snapshot' END AS c FROM lineitem) SELECT l_orderkey, CASE max(CASE c WHEN 'aggregate' THEN 2 WHEN 'snapshot' THEN 1 ELSE -1 END) WHEN 2 THEN 'aggregate' WHEN 1 THEN 'snapshot' ELSE 'none' END AS weakest, count(*) FILTER (c IS NULL) AS n_review FROM c GROUP BY l_orderkey")
def temporal_classes(spark, sf_dir):
    class_ = words.temporal_class(F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "volatile"), ("R",), ("A",), ())
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", class_.alias("c"))
    out = own.groupBy("l_orderkey").agg(F.collect_set(F.coalesce("c", F.lit("none"))).alias("s"), F.count_if(F.col("c").isNull()).alias("n_review"))
    return out.select("l_orderkey", words.weakest(F.col("s")).alias("weakest"), "n_review")


_DATES = f"SELECT o_orderkey, {pick('o_orderkey % 4', ["substr(CAST(o_orderdate AS STRING), 1, 7)", "substr(CAST(o_orderdate AS STRING), 1, 10)", "'soon'", "'2020-13'"])} AS told FROM orders"


@query(f"SELECT o_orderkey, coalesce(strftime(CASE WHEN regexp_matches(told, '^[0-9]{{4}}-[0-9]{{2}}$') THEN TRY_CAST(told || '-01' AS DATE) WHEN regexp_matches(told, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(told AS DATE) END, '%Y-%m-%d'), '-') AS as_of FROM ({_DATES})")
def as_of_dates(spark, sf_dir):
    return read(spark, sf_dir, _DATES).select("o_orderkey", F.coalesce(words.as_of_date(F.col("told")).cast("string"), F.lit("-")).alias("as_of"))


_LINKED = "SELECT o_orderkey, 'See [[Nation ' || (o_custkey % 25) || ']] and [[ Part|the part]] and [[Nation ' || (o_orderkey % 25) || '#top]].' AS body FROM orders"


@query("SELECT o_orderkey, CASE WHEN o_custkey % 25 = o_orderkey % 25 THEN 'Nation ' || (o_custkey % 25) || '|Part' ELSE 'Nation ' || (o_custkey % 25) || '|Part|Nation ' || (o_orderkey % 25) END AS links FROM orders")
def wiki_link_spans(spark, sf_dir):
    return read(spark, sf_dir, _LINKED).select("o_orderkey", F.array_join(words.wiki_links(F.col("body")), "|").alias("links"))


# --- retrieval ---

_ITEMS_T = "SELECT l_orderkey * 10 + l_linenumber AS item, l_shipmode_topic AS topic, text FROM (SELECT *, 'topic ' || (l_partkey % 12) AS l_shipmode_topic, " + pick("l_suppkey % 6", ["'why this, because of that'", "'compared with other parts, however'", "'maybe it works'", "'how to do it, step by step'", "'plain words'", "'perhaps instead'"]) + " AS text FROM lineitem) AS l"
_EVENTS = f"WITH i AS ({_ITEMS_T}), e AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, topic, '{p}' AS pattern, '{c}' AS confidence FROM i WHERE regexp_matches(text, '{w}')" for k, p, w, c in retrieval.TRIGGERS) + "), ev AS (SELECT kind, topic, pattern, count(*) AS signal_count, CASE WHEN confidence = 'low' AND count(*) >= 3 THEN 'medium' WHEN confidence = 'medium' AND count(*) >= 5 THEN 'high' ELSE confidence END AS confidence FROM e GROUP BY kind, topic, pattern, confidence) "


@query(_EVENTS + "SELECT * FROM ev")
def cognitive_events(spark, sf_dir):
    return retrieval.pattern_events(read(spark, sf_dir, _ITEMS_T))


@query(_EVENTS + "SELECT DISTINCT 'topic' AS layer, topic AS src, pattern AS dst FROM ev UNION SELECT DISTINCT 'kind', kind, pattern FROM ev")
def cognitive_graph(spark, sf_dir):
    return retrieval.pattern_graph(retrieval.pattern_events(read(spark, sf_dir, _ITEMS_T)))


_ASKED = f"SELECT s_suppkey AS question_id, {pick('s_suppkey % 4', ["'state the cause of topic'", "'compare options'", "'ask for a method move'", "'caution and claim'"])} AS question FROM supplier"
_WORDS = lambda x: f"list_distinct(list_filter({TOKENS.format(x)}, lambda t: length(t) >= 3))"


@query(_EVENTS + f", q AS (SELECT question_id, unnest({_WORDS('question')}) AS w FROM ({_ASKED})), v AS (SELECT *, unnest({_WORDS(chr(39).join(['translate(kind || ', ' ', ' || topic || ', ' ', ' || pattern, ', '_', ', ', ' ', ')']))}) AS w FROM ev), h AS (SELECT question_id, kind, topic, pattern, count(*) * 12.0 + signal_count * 3.0 + CASE confidence WHEN 'high' THEN 5.0 WHEN 'low' THEN -2.0 ELSE 0.0 END AS score FROM q JOIN v USING (w) GROUP BY question_id, kind, topic, pattern, signal_count, confidence) SELECT question_id, rank::INT AS rank, kind, topic, pattern, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, kind, pattern, topic) AS rank FROM h) WHERE rank <= 5")
def cognitive_search(spark, sf_dir):
    return retrieval.pattern_search(retrieval.pattern_events(read(spark, sf_dir, _ITEMS_T)), read(spark, sf_dir, _ASKED))


_RESULTS = "SELECT l_orderkey * 10 + l_linenumber AS id, p_name AS subject, 'sold by' AS relation, CAST(p_size AS STRING) AS year, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE p_type || ' ' || substr(p_name, 1, 4) END AS title, p_type || ' ' || p_name || ' sold in ' || l_quantity AS snippet FROM lineitem JOIN part ON l_partkey = p_partkey"


@query(f"WITH r AS (SELECT id, {_WORDS('subject')} AS s, {_WORDS('relation')} AS r, year, {_WORDS('title')} AS t, list_distinct({TOKENS.format('snippet')}) AS n FROM ({_RESULTS.replace('STRING', 'VARCHAR')})), k AS (SELECT id, s, CASE WHEN len(s) > 0 THEN len(list_intersect(s, t)) * 4 + least(len(list_intersect(s, n)), 3) + CASE WHEN len(list_intersect(s, t)) = len(s) THEN 4 ELSE 0 END ELSE 0 END + 2 * len(list_intersect(r, n)) + CASE WHEN list_contains(n, year) THEN 3 ELSE 0 END AS score FROM r) SELECT id, score::INT AS score, (len(s) = 0 OR score >= greatest(4.0, least(8.0, len(s) * 3.0)))::INT AS relevant FROM k")
def web_result_relevance(spark, sf_dir):
    from factloom.operators.text import tokens

    rows = read(spark, sf_dir, _RESULTS)
    subject = retrieval.content(F.col("subject"))
    score = retrieval.result_relevance(subject, retrieval.content(F.col("relation")), F.col("year"), retrieval.content(F.col("title")), F.array_distinct(tokens(F.col("snippet"))))
    return rows.select("id", score.alias("score"), retrieval.is_relevant(score, subject).cast("int").alias("relevant"))


_WANTED = "SELECT DISTINCT p_brand || ' ' || p_name AS surface FROM part WHERE p_size > 45"


@query(f"WITH a AS (SELECT DISTINCT surface, unnest({_WORDS('surface')}) AS w FROM ({_WANTED})), b AS (SELECT DISTINCT p_name AS label, unnest({_WORDS('p_name')}) AS w FROM part), h AS (SELECT surface, label, count(*) AS overlap FROM a JOIN b USING (w) GROUP BY ALL) SELECT surface, rank::INT AS rank, label, overlap FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY overlap DESC, label) AS rank FROM h) WHERE rank <= 5")
def keyword_candidates(spark, sf_dir):
    return retrieval.keyword_candidates(read(spark, sf_dir, _WANTED), table(spark, sf_dir, "part").select(F.col("p_name").alias("label")))


@query()
def relation_similarity(spark, sf_dir):
    """The relation of the nearest keyword vector, where it is near and apart enough; tested against brute force."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", measures.unit(F.col("embedding").cast("array<double>")).alias("v")).where("v IS NOT NULL")
    keywords = vectors.where("vec_id < 40").select(F.concat(F.lit("r"), F.col("vec_id") % 8).alias("relation"), "v")
    return retrieval.most_similar_relation(vectors.withColumnRenamed("vec_id", "phrase_id"), keywords, 0.2, 0.01)


@query(f"SELECT question_id, CASE WHEN regexp_matches(question, '(?i)^who\\b') THEN 'person' WHEN regexp_matches(question, '(?i)\\bwhere\\b') THEN 'place' ELSE 'general' END AS branch FROM ({_QUESTIONS})")
def branch_routes(spark, sf_dir):
    routed = retrieval.branch(F.col("question"), (("person", r"(?i)^who\b"), ("place", r"(?i)\bwhere\b")), F.lit("general"))
    return read(spark, sf_dir, _QUESTIONS).select("question_id", routed.alias("branch"))


_CUT = "list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) != '')"


@query(f"WITH s AS (SELECT doc_id, source, unnest({_CUT}) AS s, unnest(range(len({_CUT}))) AS k FROM documents), t AS (SELECT doc_id, k, list_distinct({TOKENS.format('s')}) AS w, [lower(source), 'the', 'der'] AS e, ['license', 'with', 'und', 'les', 'que'] AS r FROM s), c AS (SELECT doc_id, k, len(list_intersect(w, e)) AS eh, len(list_intersect(w, r)) AS rh FROM t), x AS (SELECT doc_id, k, eh * 5 + rh * 3 + CASE WHEN eh > 0 THEN 2 ELSE 0 END + greatest(0.0, 2.0 - k * 0.5) AS score FROM c WHERE rh > 0 AND (eh > 0 OR k < 3)) SELECT doc_id, arg_max(k, (score, -k))::INT AS place, max(score)::DOUBLE AS score FROM x GROUP BY doc_id")
def answer_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", F.array(F.lower("source"), F.lit("the"), F.lit("der")).alias("entity"), F.array(*(F.lit(w) for w in ("license", "with", "und", "les", "que"))).alias("relation"))
    return retrieval.answer_sentences(docs.select("doc_id", "text"), asked)


_PHRASES = {"who founded": "founded_by", "founded": "founded", "founded by": "founded_by", "head": "leader_of", "head office": "headquartered_in", "where is": "located_in", "part of": "part_of", "known for": "known_for", "used for": "used_for"}


@query(f"WITH q AS (SELECT question_id, {TOKENS.format('question')} AS t FROM ({_QUESTIONS})), p(phrase, predicate, n) AS (VALUES {', '.join(f"('{k}', '{v}', {len(k.split())})" for k, v in _PHRASES.items())}), h AS (SELECT question_id, place, phrase, predicate, n FROM (SELECT question_id, t, unnest(range(len(t))) AS place FROM q) JOIN p ON array_to_string(list_slice(t, place + 1, place + n), ' ') = phrase) SELECT question_id, predicate, min(place)::INT AS place FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.question_id = a.question_id AND b.n > a.n AND b.place < a.place + a.n AND a.place < b.place + b.n) GROUP BY question_id, predicate")
def phrase_predicates(spark, sf_dir):
    phrases = spark.createDataFrame(list(_PHRASES.items()), "phrase string, predicate string")
    return retrieval.phrase_predicates(read(spark, sf_dir, _QUESTIONS), phrases)


# --- event stream ---

_TECHNIQUES = ("click", "error", "purchase", "signup", "view")


@query(ALERTS + "SELECT a.event_id, value AS base_level, " + ", ".join(f"(technique = '{t}')::INT::DOUBLE AS base_technique_{t}" for t in _TECHNIQUES) + ", " + ", ".join(f"(floor(hour(a.ts) / 6) = {b})::INT::DOUBLE AS base_band_{b}" for b in range(4)) + ", (dayofweek(a.ts) IN (0, 6))::INT::DOUBLE AS base_is_weekend FROM a JOIN events USING (event_id)")
def baseline_features(spark, sf_dir):
    return retrieval.baseline_features(events.alerts(table(spark, sf_dir, "events")), _TECHNIQUES)


_PAYLOADS = f"SELECT event_id, {pick('user_id % 6', [chr(39) + p + chr(39) for p in ('<"data": <"KES": 1>>', '<"data": <"src_ip": "x">>', '<"data": <"win": <"eventdata": <"commandLine": "cmd">>>>', '<"data": <"win": <"eventdata": <>>>>', '<"data": <"alert": 2, "win": <>>>', '<"k": 1>')])} AS payload FROM events"


@query("SELECT event_id, CASE user_id % 6 WHEN 0 THEN 'kes' WHEN 1 THEN 'suricata' WHEN 2 THEN 'sysmon_process' WHEN 3 THEN 'sysmon_auth' WHEN 4 THEN 'suricata' ELSE 'unknown' END AS source FROM events")
def event_sources(spark, sf_dir):
    return read(spark, sf_dir, _PAYLOADS, "events").select("event_id", retrieval.event_source(F.translate("payload", "<>", "{}")).alias("source"))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'purchase', 'signup')")
def scored_techniques(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase", "signup")).select("event_id", "event_type")


@query(ALERTS + ", p AS (SELECT *, coalesce(lag(technique) OVER (PARTITION BY actor ORDER BY us, event_id), '-') AS parent FROM a) SELECT event_id, (row_number() OVER (PARTITION BY host, parent, technique ORDER BY us, event_id) = 1)::INT AS chain_novel FROM p")
def process_chain_novelty(spark, sf_dir):
    from pyspark.sql import Window

    rows = events.alerts(table(spark, sf_dir, "events"))
    rows = rows.withColumn("parent", F.coalesce(F.lag("technique").over(Window.partitionBy("actor").orderBy("us", "event_id")), F.lit("-")))
    return events.with_firsts(rows, "chain_novel", "host", "parent", "technique").select("event_id", "chain_novel")


@query("SELECT CASE WHEN user_id % 10 = 3 THEN 'recurring' ELSE 'other' END AS kind, count(*) AS n, round(avg((value >= 100)::INT), 6) AS share FROM events WHERE event_type != 'error' GROUP BY 1")
def legit_false_positives(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type != 'error'").withColumn("flagged", (F.col("value") >= 100).cast("int"))
    return retrieval.flagged_share(rows, F.when(F.col("user_id") % 10 == 3, "recurring").otherwise("other"), "kind")


@query("SELECT event_type, count(*) AS n, round(avg((value BETWEEN 40 AND 60)::INT), 6) AS share FROM events GROUP BY event_type")
def routing_by_type(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("flagged", F.col("value").between(40, 60).cast("int"))
    return retrieval.flagged_share(rows, F.col("event_type"), "event_type")


@query("SELECT count(*) AS n FROM events")
def volume_guard(spark, sf_dir):
    return retrieval.volume_guard(table(spark, sf_dir, "events"), 10**15)


@query("WITH m AS (SELECT event_type, round(avg(value), 6) AS measured, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type) SELECT event_type, measured, share, round(measured - 100.0, 6) AS gap FROM m")
def calibration_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    total = rows.agg(F.count("*").alias("total"))
    own = rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("measured"), F.count("*").alias("n")).join(total)
    return own.select("event_type", "measured", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(F.col("measured") - 100.0, 6).alias("gap"))


@query("WITH x AS (SELECT event_type, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY event_type) SELECT event_type AS metric, round(a, 6) AS first, round(b, 6) AS second, round(b - a, 6) AS delta FROM x")
def corpus_delta(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    half = lambda k, name: rows.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias(name))
    both = half(0, "first").join(half(1, "second"), "metric", "full")
    return both.select("metric", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), F.round(F.col("second") - F.col("first"), 6).alias("delta"))
