"""Retrieval and patterns of thought: scored search, routes, answer sentences, pattern events and their graph, baseline features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.text import tokens

# Triggers of pattern events: kind, pattern, words, confidence.
TRIGGERS = (
    ("reasoning_move", "compare_options", r"(?i)\b(versus|compared|instead|rather)\b", "medium"),
    ("reasoning_move", "state_tradeoff", r"(?i)\b(but|however|although|tradeoff)\b", "medium"),
    ("question_move", "ask_for_cause", r"(?i)\b(why|because|reason)\b", "high"),
    ("question_move", "ask_for_method", r"(?i)\b(how|step|method)\b", "medium"),
    ("caution", "hedge_claim", r"(?i)\b(maybe|perhaps|might|probably)\b", "low"),
)


def content(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= least))


def best_of(rows: DataFrame, key: str, top: int, *order: Column, columns: tuple[str, ...]) -> DataFrame:
    """The best rows of each key with their rank, ties by ``columns``; Spark cuts a key's rows to ``top`` in each task before they are shuffled."""
    best = Window.partitionBy(key).orderBy(*order, *columns)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(key, "rank", *columns)


def pattern_events(items: DataFrame) -> DataFrame:
    """(kind, topic, pattern, signal_count, confidence): events that triggers find in (item, topic, text), merged; three signals make a low confidence medium, five a medium one high."""
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(words), F.struct(F.lit(k).alias("kind"), F.lit(p).alias("pattern"), F.lit(c).alias("confidence"))) for k, p, words, c in TRIGGERS)))
    rows = items.select("topic", F.explode(found).alias("e")).select("topic", "e.*")
    out = rows.groupBy("kind", "topic", "pattern").agg(F.count("*").alias("signal_count"), F.min("confidence").alias("_c"))
    raised = F.when((F.col("_c") == "low") & (F.col("signal_count") >= 3), "medium").when((F.col("_c") == "medium") & (F.col("signal_count") >= 5), "high").otherwise(F.col("_c"))
    return out.select("kind", "topic", "pattern", "signal_count", raised.alias("confidence"))


def pattern_search(events: DataFrame, questions: DataFrame, top: int = 5) -> DataFrame:
    """(question_id, rank, kind, topic, pattern, score): 12 a matched word, 3 a signal, more or less by confidence; ties by kind, pattern, topic."""
    words = content(F.translate(F.concat_ws(" ", "kind", "topic", "pattern"), "_", " "))
    rows = events.select("*", F.explode(words).alias("w"))
    asked = questions.select("question_id", F.explode(content(F.col("question"))).alias("w"))
    # hits are dealt by question before they are counted: many questions share few words, and those of a word meet in one task
    parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = asked.join(rows, "w").repartition(parts, "question_id")
    hits = hits.groupBy("question_id", "kind", "topic", "pattern", "signal_count", "confidence").agg(F.count("*").alias("k"))
    bonus = F.when(F.col("confidence") == "high", 5.0).when(F.col("confidence") == "low", -2.0).otherwise(0.0)
    scored = hits.withColumn("score", F.col("k") * 12.0 + F.col("signal_count") * 3.0 + bonus)
    return best_of(scored, "question_id", top, -F.col("score"), F.col("kind"), F.col("pattern"), F.col("topic"), columns=("kind", "topic", "pattern", "score"))


def pattern_graph(events: DataFrame) -> DataFrame:
    """(layer, src, dst): distinct edges from topics to patterns, and from kinds to patterns."""
    edge = lambda layer, src: events.select(F.lit(layer).alias("layer"), F.col(src).alias("src"), F.col("pattern").alias("dst"))
    return edge("topic", "topic").unionByName(edge("kind", "kind")).distinct()


def result_relevance(subject: Column, relation: Column, year: Column, title: Column, snippet: Column) -> Column:
    """4 a word of the subject in the title, up to 3 in the snippet, 4 if the title has all; 2 a relation word, 3 for the year."""
    in_title = F.size(F.array_intersect(subject, title))
    some = F.size(subject) > 0
    score = F.when(some, in_title * 4 + F.least(F.size(F.array_intersect(subject, snippet)), F.lit(3)) + F.when(in_title == F.size(subject), 4).otherwise(0)).otherwise(0)
    return score + 2 * F.size(F.array_intersect(relation, snippet)) + F.when(F.array_contains(snippet, year), 3).otherwise(0)


def is_relevant(score: Column, subject: Column) -> Column:
    return (F.size(subject) == 0) | (score >= F.greatest(F.lit(4.0), F.least(F.lit(8.0), F.size(subject) * 3.0)))


def keyword_candidates(wanted: DataFrame, entities: DataFrame, top: int = 5) -> DataFrame:
    """(surface, rank, label, overlap): entities by shared words with a surface, most first, then by label."""
    a = wanted.select("surface", F.explode(content(F.col("surface"))).alias("w"))
    b = entities.select("label", F.explode(content(F.col("label"))).alias("w"))
    hits = a.distinct().join(b.distinct(), "w").groupBy("surface", "label").agg(F.count("*").alias("overlap"))
    return best_of(hits, "surface", top, -F.col("overlap"), F.col("label"), columns=("label", "overlap"))


def most_similar_relation(phrases: DataFrame, keywords: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(phrase_id, relation, best, second): the relation whose nearest keyword is nearest, where near and apart enough, else null.

    ``phrases`` is (phrase_id, v), ``keywords`` (relation, v) with unit vectors; keywords are few by their nature and checked.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    most = 10_000
    table = keywords.limit(most + 1).agg(F.collect_list(F.struct("relation", "v")).alias("all"))
    table = table.select(F.when(F.size("all") > most, F.raise_error(F.lit(f"more than {most} keywords")).cast("array<struct<relation:string,v:array<double>>>")).otherwise(F.col("all")).alias("all"))
    near = F.transform("all", lambda k: F.struct(F.round(dot(F.col("v"), k["v"]), 6).alias("s"), k["relation"].alias("r")))
    rows = phrases.join(F.broadcast(table), how="cross").select("phrase_id", F.sort_array(near, asc=False).alias("n"))
    first = F.col("n")[0]
    other = F.get(F.filter("n", lambda k: k["r"] != first["r"]), F.lit(0))["s"]
    second = F.coalesce(other, F.lit(-1.0))
    good = (first["s"] >= threshold) & (first["s"] - second >= margin)
    return rows.select("phrase_id", F.when(good, first["r"]).alias("relation"), first["s"].alias("best"), second.alias("second"))


def branch(text: Column, fast: tuple[tuple[str, str], ...], fallback: Column) -> Column:
    """The first route whose pattern a question matches, else the fallback."""
    return reduce(lambda w, r: w.when(text.rlike(r[1]), r[0]), fast, F.when(F.lit(False), "")).otherwise(fallback)


def answer_sentences(documents: DataFrame, questions: DataFrame, lead: int = 3) -> DataFrame:
    """(doc_id, place, score): of each document the sentence that answers best: 5 an entity word, 3 a relation word, 2 if it names the subject, and a little for being early.

    ``questions`` is one row for each document: (doc_id, entity, relation), arrays of words. A sentence
    without a relation word doesn't count, nor a late one that doesn't name the subject; ties go to the first.
    """
    cut = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"([.!?])[ \t\r\n]+", "$1\n"), "\n"), lambda s: F.trim(s) != "")
    rows = documents.select("doc_id", F.transform(cut, lambda s, k: F.struct(k.alias("place"), F.array_distinct(tokens(s)).alias("w"))).alias("s")).join(questions, "doc_id")

    def scored(s: Column) -> Column:
        e, r = F.size(F.array_intersect(s["w"], F.col("entity"))), F.size(F.array_intersect(s["w"], F.col("relation")))
        score = e * 5 + r * 3 + F.when(e > 0, 2).otherwise(0) + F.greatest(F.lit(0.0), 2.0 - s["place"] * 0.5)
        return F.when((r > 0) & ((e > 0) | (s["place"] < lead)), F.struct(score.alias("score"), (-s["place"]).alias("minus")))

    best = F.array_max(F.transform("s", scored))
    return rows.select("doc_id", best.alias("b")).where("b IS NOT NULL").select("doc_id", (-F.col("b.minus")).alias("place"), F.col("b.score").alias("score"))


def phrase_predicates(questions: DataFrame, phrases: DataFrame, longest: int = 4) -> DataFrame:
    """(question_id, place, predicate): predicates that a question's phrases denote, longest phrase first where they overlap, by first place.

    ``phrases`` is (phrase, predicate), of plain words.
    """
    known = phrases.where("phrase IS NOT NULL").distinct()
    rows = questions.where("question_id IS NOT NULL").select("question_id", tokens(F.col("question")).alias("t"))
    # the words from each place on, where a phrase begins with the first of them
    ahead = F.transform("t", lambda w, k: F.struct(k.alias("place"), w.alias("_first"), F.slice("t", k + 1, F.lit(longest)).alias("ahead")))
    firsts = known.select(F.substring_index("phrase", " ", 1).alias("_first")).distinct()
    rows = rows.select("question_id", F.explode(ahead).alias("a")).select("question_id", "a.*").join(firsts, "_first")
    gram = lambda n: F.struct(n.alias("n"), F.array_join(F.slice("ahead", F.lit(1), n), " ").alias("phrase"))
    grams = F.transform(F.sequence(F.lit(1), F.size("ahead")), gram)
    hits = rows.select("question_id", "place", F.explode(grams).alias("g")).select("question_id", "place", "g.*").join(known, "phrase")
    # a question's hits meet once; a span of several predicates keeps them all
    spans = hits.groupBy("question_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("n")).alias("m"), "place", "n", "predicate"))).alias("s"))
    meets = lambda s, k: (s["place"] < k["place"] + k["n"]) & (k["place"] < s["place"] + s["n"]) & ~((s["place"] == k["place"]) & (s["n"] == k["n"]))
    add = lambda kept, s: F.when(F.exists(kept, lambda k: meets(s, k)), kept).otherwise(F.array_append(kept, s))
    kept = F.aggregate("s", F.array().cast("array<struct<m:int,place:int,n:int,predicate:string>>"), add)
    by_place = spans.select("question_id", F.array_sort(F.transform(kept, lambda k: F.struct(k["place"].alias("place"), k["predicate"].alias("predicate")))).alias("k"))
    first = F.filter("k", lambda r, i: ~F.exists(F.slice("k", F.lit(1), i), lambda e: e["predicate"].eqNullSafe(r["predicate"])))
    return by_place.select("question_id", F.explode(first).alias("r")).select("question_id", "r.predicate", "r.place")


def baseline_features(rows: DataFrame, techniques: tuple[str, ...]) -> DataFrame:
    """Level, one-hot technique and hour band, and weekend, of each alert alone."""
    hour = F.floor(F.hour("ts") / 6)
    own = {"base_level": F.col("level"), **{f"base_technique_{t}": (F.col("technique") == t).cast("double") for t in techniques}, **{f"base_band_{b}": (hour == b).cast("double") for b in range(4)}}
    return rows.select("event_id", *(c.alias(n) for n, c in own.items()), F.dayofweek("ts").isin(1, 7).cast("double").alias("base_is_weekend"))


def event_source(payload: Column) -> Column:
    """The kind of source of an event's JSON, by what it holds, in order."""
    has = lambda path: F.get_json_object(payload, f"$.data.{path}").isNotNull()
    line = F.coalesce(F.get_json_object(payload, "$.data.win.eventdata.commandLine"), F.lit(""))
    return F.when(has("KES"), "kes").when(has("alert") | has("src_ip"), "suricata").when(has("win"), F.when(line != "", "sysmon_process").otherwise("sysmon_auth")).otherwise("unknown")


def flagged_share(rows: DataFrame, group: Column, name: str) -> DataFrame:
    """(group, n, share): share of flagged rows among those of a group."""
    return rows.groupBy(group.alias(name)).agg(F.count("*").alias("n"), F.round(F.avg("flagged"), 6).alias("share"))


def volume_guard(rows: DataFrame, most: int) -> DataFrame:
    """One row with the number of rows; more than ``most`` are an error."""
    return rows.agg(F.count("*").alias("n")).select(F.when(F.col("n") > most, F.raise_error(F.lit("too many rows for one pull")).cast("long")).otherwise(F.col("n")).alias("n"))
