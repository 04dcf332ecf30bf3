"""Registered queries: answer plans, gates, surfaces, search, votes, composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import corpus, evidence, gates
from factloom.operators.joins import top_rows
from factloom.operators.text import ngrams, tokens
from factloom.plans.shared import PLAIN, TOKENS, query, table, view
from factloom.sources.facts import facts

# --- answer plans ---

_EMPTY = ", ".join(f"'{w}'" for w in evidence.EMPTY_WORDS)
_ASKED = "SELECT p_partkey AS question_id, 'part ' || p_partkey AS target, 'who published part ' || p_partkey || ' and what goods are these' AS text FROM part"


def _content(text):
    return f"list_distinct(list_filter({TOKENS.format(text)}, lambda t: length(t) > 2 AND t NOT IN ({_EMPTY})))"


def _minus(left, right):
    return f"len(list_filter({left}, lambda x: NOT list_contains({right}, x)))"


def _step(k):
    """One round of the greedy walk: candidates, the best of each question, the next state."""
    shared = "len(list_filter(terms, lambda x: list_contains(words, x)))"
    total = (
        f"round(0.25 * {shared} / greatest(1, least(len(terms), len(words))) + 0.2 * quality + 0.05 + 0.2 * CASE WHEN node = nodes[1] THEN 1.0 ELSE 0.8 END"
        f" + 0.25 * gain + 0.1 * CASE WHEN list_contains(used, node || '|' || predicate) THEN 0 ELSE 1 END - 0.25 * (1 - gain) - {0.05 * k}, 6)"
    )
    wanted = "TRUE" if k else f"{shared} > 0"
    least = evidence.NEXT_TOTAL if k else evidence.FIRST_TOTAL
    return f"""
 c{k} AS (SELECT s.*, e.* EXCLUDE (node), {_minus('payload', 'covered')}::DOUBLE / greatest(1, len(payload)) AS gain FROM (SELECT *, unnest(nodes) AS node FROM s{k} WHERE len(plan) = {k}) s JOIN e ON e.node = s.node WHERE NOT list_contains(plan, ord)),
 t{k} AS (SELECT *, {total} AS total FROM c{k} WHERE {wanted}),
 b{k} AS (SELECT * FROM t{k} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY total DESC, ord) = 1),
 g{k} AS (SELECT * FROM b{k} WHERE total >= {least} AND gain >= {evidence.LEAST_GAIN}),
 s{k + 1} AS (SELECT question_id, terms, list_concat(covered, payload) AS covered, list_append(nodes, next) AS nodes, list_append(used, node || '|' || predicate) AS used, list_append(plan, ord) AS plan, list_append(totals, total) AS totals FROM g{k} UNION ALL SELECT question_id, terms, covered, nodes, used, plan, totals FROM s{k} WHERE question_id NOT IN (SELECT question_id FROM g{k}))"""


@query(
    view("is_a", "published_by")
    + f""", e AS (SELECT lower(subject) AS node, ord, predicate, lower(object) AS next, {_content("subject || ' ' || predicate || ' ' || object")} AS words, {_content('object')} AS payload, least(1.0, 0.4 + CASE stability WHEN 'stable' THEN 0.3 WHEN 'semi_stable' THEN 0.2 ELSE 0.05 END + CASE WHEN risk = 'low' THEN 0.3 WHEN risk IN ('', 'medium') THEN 0.15 ELSE 0 END)::DOUBLE AS quality FROM facts),
 s0 AS (SELECT question_id, {_content('text')} AS terms, {_content('target')} AS covered, [lower(target)] AS nodes, []::VARCHAR[] AS used, []::BIGINT[] AS plan, []::DOUBLE[] AS totals FROM ({_ASKED})),"""
    + ",".join(_step(k) for k in range(4))
    + " SELECT question_id, array_to_string(plan, ',') AS plan, len(plan)::BIGINT AS steps, CASE WHEN len(totals) > 0 THEN totals[len(totals)] END AS last_total FROM s4"
)
def answer_plan(spark, sf_dir):
    asked = spark.sql(_ASKED.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    out = evidence.answer_plans(facts(spark, sf_dir, "is_a", "published_by"), asked)
    return out.select("question_id", F.array_join(F.col("plan").cast("array<string>"), ",").alias("plan"), F.size("plan").cast("long").alias("steps"), F.try_element_at("totals", F.lit(-1)).alias("last_total"))


# --- gates ---

_GENERIC, _BROAD = (", ".join(f"'{w}'" for w in words) for words in (gates.GENERIC_SUBJECTS, gates.BROAD_CLASSES))
_JUDGED = f"""j AS (SELECT predicate, CASE WHEN lower(subject) = lower(object) THEN 'reject:self_relation' WHEN lower(subject) IN ('', {_GENERIC}) THEN 'reject:generic_subject' WHEN stability = 'volatile' THEN 'quarantine:volatile_evidence'
 WHEN predicate = 'is_a' AND lower(object) IN ({_BROAD}) THEN 'reject:is_a_object_too_broad' ELSE 'accept:none' END AS v, CASE WHEN stability = 'volatile' OR risk = 'high' THEN 'reject:volatile_or_high_risk' WHEN stability NOT IN ('stable', 'semi_stable') THEN 'reject:relation_stability_not_safe' ELSE 'accept:none' END AS w FROM facts),
 k AS (SELECT predicate, CASE WHEN v = 'accept:none' THEN w ELSE v END AS d, CASE WHEN v = 'accept:none' THEN 2 ELSE 1 END AS gate FROM j)"""


@query(view() + f", {_JUDGED}, p AS (SELECT predicate, split_part(d, ':', 1) AS verdict, split_part(d, ':', 2) AS reason FROM k) SELECT predicate, verdict, '*' AS reason, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT '*', verdict, reason, count(*) FROM p GROUP BY ALL UNION ALL SELECT '*', '*', '*', count(*) FROM p")
def firewall_counters(spark, sf_dir):
    judged = facts(spark, sf_dir).select("predicate", gates.chained(gates.delta_verdict(), gates.admission()).alias("g"))
    return gates.counters(judged.select("predicate", "g.verdict", "g.reason"))


@query(view() + f", {_JUDGED} SELECT gate::BIGINT AS gate, split_part(d, ':', 1) AS verdict, count(*) AS n FROM k GROUP BY ALL")
def chained_gates(spark, sf_dir):
    judged = facts(spark, sf_dir).select(gates.chained(gates.delta_verdict(), gates.admission()).alias("g"))
    return judged.groupBy(F.col("g.gate").cast("long").alias("gate"), "g.verdict").agg(F.count("*").alias("n"))


_SENTENCES = "list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s) != '')"
_WHY = "CASE " + " ".join(f"WHEN regexp_matches(' ' || {PLAIN.format('s')} || ' ', ' {phrase} ') THEN '{name}'" for name, phrase in gates.SCREENS) + " END"


@query(f"WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents), w AS (SELECT doc_id, {_WHY} AS why FROM s) SELECT d.doc_id, count(w.doc_id) AS n_sentences, " + ", ".join(f"count(*) FILTER (why = '{name}') AS n_{name}" for name, _ in gates.SCREENS) + ", count(*) FILTER (w.doc_id IS NOT NULL AND why IS NULL) AS n_safe FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id")
def sentence_screens(spark, sf_dir):
    return gates.screened(table(spark, sf_dir, "documents"))


@query("SELECT page_id, (reasons = '')::BIGINT AS ready, reasons FROM (SELECT page_id, concat_ws('|', CASE WHEN length(coalesce(html, '')) <= 500 THEN 'raw_text_missing_or_short' END, CASE WHEN coalesce(url, '') = '' THEN 'source_url_missing' END, CASE WHEN NOT contains(lower(coalesce(html, '')), '<title>') THEN 'title_missing' END, CASE WHEN contains(lower(coalesce(html, '')), 'page not found') OR contains(lower(coalesce(html, '')), '404 not found') THEN 'missing_or_error_page' END, CASE WHEN contains(lower(coalesce(html, '')), 'may refer to:') THEN 'disambiguation_like_page' END) AS reasons FROM pages)")
def page_readiness(spark, sf_dir):
    return gates.readiness(table(spark, sf_dir, "pages"))


# --- texts ---

_NGRAMS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
_SURFACE = " UNION ".join(f"SELECT array_to_string(w[1:{n}], ' ') AS surface FROM (SELECT {TOKENS.format('text')} AS w FROM benchmark) WHERE len(w) >= {n}" for n in (2, 3))
_GRAM = " UNION ALL ".join(f"SELECT doc_id, unnest(range(0, len(w) - {n} + 1)) AS place, {n} AS n, unnest({_NGRAMS.format(n=n)}) AS surface FROM t WHERE len(w) >= {n}" for n in (1, 2, 3))


@query(f"WITH RECURSIVE t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents), f AS ({_SURFACE}), b AS (SELECT g.* FROM ({_GRAM}) g JOIN f USING (surface) QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY n DESC) = 1), x AS (SELECT b.doc_id, b.place, b.n, b.surface, min(c.place) AS next FROM b LEFT JOIN b c ON b.doc_id = c.doc_id AND c.place >= b.place + b.n GROUP BY ALL), walk AS (SELECT x.* FROM x JOIN (SELECT doc_id, min(place) AS place FROM x GROUP BY doc_id) USING (doc_id, place) UNION ALL SELECT x.* FROM x JOIN walk ON x.doc_id = walk.doc_id AND x.place = walk.next) SELECT doc_id, place::BIGINT AS place, n::BIGINT AS n, surface FROM walk")
def surface_spans(spark, sf_dir):
    own = table(spark, sf_dir, "benchmark").select(tokens(F.col("text")).alias("w"))
    known = [own.where(F.size("w") >= n).select(F.array_join(F.slice("w", 1, n), " ").alias("surface")) for n in (2, 3)]
    out = corpus.spans(table(spark, sf_dir, "documents"), known[0].unionByName(known[1]))
    return out.select("doc_id", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"), "surface")


_KNOWN = f"list_distinct(list_filter({TOKENS.format('text')}, lambda t: length(t) >= 5))"


@query(f"WITH d AS (SELECT doc_id, {_KNOWN} AS d FROM documents), q AS (SELECT item_id, {_KNOWN} AS q FROM benchmark), s AS (SELECT item_id, doc_id, len(list_filter(q, lambda x: length(x) >= 9 AND list_contains(d, x))) AS hits, least(2, len(list_filter(q, lambda x: length(x) >= 9))) AS need, len(list_filter(q, lambda x: list_contains(d, x))) AS matched FROM d, q), r AS (SELECT item_id, doc_id, hits * 15 + matched * 2 AS score FROM s WHERE hits >= need AND hits > 0) SELECT item_id, rank::BIGINT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 5")
def community_search(spark, sf_dir):
    return corpus.community_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"WITH k AS (SELECT DISTINCT unnest({_NGRAMS.format(n=3)}) AS gram FROM (SELECT {TOKENS.format('text')} AS w FROM documents)), g AS (SELECT conv_id, turn, unnest({_NGRAMS.format(n=3)}) AS gram FROM (SELECT conv_id, turn, {TOKENS.format('text')} AS w FROM conversations)) SELECT c.conv_id, c.turn, count(g.gram) AS n_grams, round(count(k.gram) / nullif(count(g.gram), 0), 6) AS share FROM conversations c LEFT JOIN g ON c.conv_id = g.conv_id AND c.turn = g.turn LEFT JOIN k ON g.gram = k.gram GROUP BY c.conv_id, c.turn")
def proxy_fluency(spark, sf_dir):
    return corpus.fluency(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "documents"))


@query(f"WITH st AS (SELECT split_part(g, ' ', 1) AS x, split_part(g, ' ', 2) AS y, count(*) AS n FROM (SELECT unnest({_NGRAMS.format(n=2)}) AS g FROM (SELECT {TOKENS.format('text')} AS w FROM conversations)) GROUP BY ALL), p AS (SELECT DISTINCT split_part(g, ' ', 1) AS a, split_part(g, ' ', 2) AS b FROM (SELECT unnest({_NGRAMS.format(n=2)}) AS g FROM (SELECT {TOKENS.format('text')} AS w FROM benchmark))), r AS (SELECT a, b, 4 * n AS part FROM p JOIN st ON a = x AND b = y UNION ALL SELECT a, b, least(f.n, 3) * l.n FROM p JOIN st f ON f.x = a JOIN st l ON l.x = f.y AND l.y = b), s AS (SELECT a, b, sum(part) AS score FROM r GROUP BY a, b) SELECT a, b, coalesce(score, 0)::BIGINT AS score FROM p LEFT JOIN s USING (a, b)")
def link_scores(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.explode(ngrams(F.col("text"), 2)).alias("g"))
    asked = asked.select(F.element_at(F.split("g", " "), 1).alias("a"), F.element_at(F.split("g", " "), 2).alias("b"))
    return corpus.link_scores(table(spark, sf_dir, "conversations"), asked)


@query(f"WITH t AS (SELECT lang, unnest({TOKENS.format('text')}) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT lang, term, n, round(n / sum(n) OVER (PARTITION BY term), 6) AS share FROM c) SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY share DESC, n DESC, term) AS rank, term, n, share FROM s WHERE n >= 5) WHERE rank <= 12")
def signature_terms(spark, sf_dir):
    return corpus.signature_terms(table(spark, sf_dir, "documents"), "lang")


@query(f"SELECT conv_id, turn, {PLAIN.format('text')} AS text FROM conversations WHERE {PLAIN.format('text')} != ''")
def posting_rebuild(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(tokens(F.col("text"))).alias("at", "word"))
    return corpus.rebuilt(words.groupBy("conv_id", "turn", "word").agg(F.collect_list("at").alias("positions")), "conv_id", "turn")


@query(f"WITH l AS (SELECT conv_id, turn, {TOKENS.format('text')} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role != 'system' AND trim(coalesce(text, '')) != ''), x AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS place FROM l WHERE k <= 3), s AS (SELECT conv_id, word, turn, min(place) AS place FROM x WHERE length(word) >= 12 GROUP BY conv_id, word, turn QUALIFY row_number() OVER (PARTITION BY conv_id, word ORDER BY turn DESC) = 1) SELECT conv_id, string_agg(word, ' ' ORDER BY turn, place) AS entities FROM s GROUP BY conv_id")
def entities_in_window(spark, sf_dir):
    return corpus.entities_in_window(table(spark, sf_dir, "conversations"))


# --- votes, frames, layers, cohorts ---


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS k FROM orders GROUP BY ALL) SELECT o_custkey, arg_min(o_orderpriority, {'k': -k, 'p': o_orderpriority}) AS best, max(k) AS n, sum(k)::BIGINT AS votes, (sum(k) >= 3 AND max(k) >= 0.4 * sum(k))::BIGINT AS decided FROM c GROUP BY o_custkey")
def entity_type_vote(spark, sf_dir):
    return corpus.vote(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT o_custkey, min(o_orderstatus) AS o_orderstatus, count(*) AS support FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1 AND count(*) >= 2")
def relation_input_training(spark, sf_dir):
    return corpus.single_meaning(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("WITH u AS (SELECT p_name, p_brand, 1 AS layer, p_partkey AS ord FROM part WHERE p_size <= 25 UNION ALL SELECT p_name, p_brand, 2, p_partkey FROM part WHERE p_size > 20) SELECT p_name, p_brand, min(layer)::BIGINT AS layer, arg_min(ord, {'l': layer, 'o': ord}) AS ord FROM u GROUP BY ALL")
def overlay_composition(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_size", F.col("p_partkey").alias("ord"))
    out = corpus.composed(parts.where("p_size <= 25").drop("p_size"), parts.where("p_size > 20").drop("p_size"))
    return out.withColumn("layer", F.col("layer").cast("long"))


@query(view() + ", f AS (SELECT lower(subject) AS node, count(*) AS relations, count(*) FILTER (predicate = 'is_a') AS definitions, count(DISTINCT predicate) AS groups FROM facts GROUP BY ALL) SELECT node, relations, (relations >= 3)::BIGINT AS well_covered, (groups = 1)::BIGINT AS single_group FROM f")
def coverage_score(spark, sf_dir):
    per = facts(spark, sf_dir).groupBy(F.lower("subject").alias("node"), "predicate").agg(F.count("*").alias("n"))
    out = per.groupBy("node").agg(F.sum("n").alias("relations"), F.count("*").alias("groups"))
    return out.select("node", "relations", (F.col("relations") >= 3).cast("long").alias("well_covered"), (F.col("groups") == 1).cast("long").alias("single_group"))


@query("WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY ALL), l AS (SELECT day, n, n - lag(n) OVER (ORDER BY day) AS gain FROM d ORDER BY day DESC LIMIT 5) SELECT count(*) AS batches, sum(n)::BIGINT AS yield, count(*) FILTER (n = 0) AS zero_yield, (count(*) FILTER (gain < 0) > 0)::BIGINT AS any_decline FROM l")
def recent_window_metrics(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    last = days.orderBy(F.desc("day")).limit(6).withColumn("gain", F.expr("n - lag(n) OVER (ORDER BY day)")).orderBy(F.desc("day")).limit(5)
    return last.agg(F.count("*").alias("batches"), F.sum("n").alias("yield"), F.count_if(F.col("n") == 0).alias("zero_yield"), (F.count_if(F.col("gain") < 0) > 0).cast("long").alias("any_decline"))


@query("SELECT user_id, event_type, arg_min(value, event_id) AS first_value, count(*) AS repeats FROM events GROUP BY ALL")
def collapse_repeats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("first_value"), F.count("*").alias("repeats"))


@query(f"WITH t AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations), w AS (SELECT {TOKENS.format('line')} AS w FROM t), e AS (SELECT split_part(g, ' ', 1) AS src, split_part(g, ' ', 2) AS dst, count(*) AS weight FROM (SELECT unnest({_NGRAMS.format(n=2)}) AS g FROM w) GROUP BY ALL) SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank, dst, weight FROM e) WHERE rank <= 12")
def strongest_edges(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    steps = lines.select(F.explode(ngrams(F.col("line"), 2)).alias("g")).groupBy("g").agg(F.count("*").alias("weight"))
    edges = steps.select(F.element_at(F.split("g", " "), 1).alias("src"), F.element_at(F.split("g", " "), 2).alias("dst"), "weight")
    return top_rows(edges, ["src"], [F.desc("weight"), F.col("dst")], 12).select("src", "rank", "dst", "weight")
