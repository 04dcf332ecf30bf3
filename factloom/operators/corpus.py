"""Corpus operators: surfaces in texts, search in two steps, fluency, link scores, votes, rebuilt texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.lineage import cut
from factloom.operators.text import grams_of_blocks, ngrams, tokens


def spans(documents: DataFrame, surfaces: DataFrame, longest: int = 3) -> DataFrame:
    """(doc_id, place, n, surface): known surfaces in each text, leftmost first, then longest, without overlap.

    ``surfaces`` is (surface), plain words with single spaces, ``longest`` words at most;
    places count words from 0. Only words that begin a surface are followed by n-grams, which meet the surfaces in one join; the spans of one
    text, fewer than its words, are chosen in order.
    """

    known = surfaces.where("surface IS NOT NULL").select("surface", F.substring_index("surface", " ", 1).alias("first")).distinct()
    rows = documents.select("doc_id", tokens(F.col("text")).alias("w"))
    # the words from each place on, where a surface begins with the first of them
    ahead = F.transform("w", lambda w, k: F.struct(k.alias("place"), w.alias("first"), F.slice("w", k + 1, F.lit(longest)).alias("ahead")))
    rows = rows.select("doc_id", F.explode(ahead).alias("a")).select("doc_id", "a.*").join(known.select("first").distinct(), "first")
    gram = lambda n: F.struct(n.alias("n"), F.array_join(F.slice("ahead", F.lit(1), n), " ").alias("surface"))
    rows = rows.select("doc_id", "place", F.explode(F.transform(F.sequence(F.lit(1), F.size("ahead")), gram)).alias("g")).select("doc_id", "place", "g.*")
    hits = rows.join(known.select("surface"), "surface").groupBy("doc_id", "place").agg(F.max_by(F.struct("n", "surface"), "n").alias("b"))
    in_order = F.array_sort(F.collect_list(F.struct("place", "b.n", "b.surface")))
    chosen = F.aggregate(
        in_order,
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<place:int,n:int,surface:string>>").alias("kept")),
        lambda acc, s: F.when(s["place"] >= acc["end"], F.struct((s["place"] + s["n"]).alias("end"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc),
        lambda acc: acc["kept"],
    )
    return hits.groupBy("doc_id").agg(chosen.alias("s")).select("doc_id", F.inline("s"))


def community_search(documents: DataFrame, questions: DataFrame, top: int = 5, strong: int = 9, weak: int = 5) -> DataFrame:
    """(item_id, rank, doc_id, score): 15 a shared strong word, 2 a shared word; the ``top`` of each question.

    Words of ``strong`` letters are strong, of ``weak`` or more count. Questions of two strong
    words or more need two hits. Strong words find the pairs; all words are compared only there. Ties to the smaller doc_id.
    """
    words = lambda text: F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= weak))
    strongs = lambda c: F.filter(c, lambda t: F.length(t) >= strong)
    asked = questions.select("item_id", words(F.col("text")).alias("q"))
    own = documents.select("doc_id", words(F.col("text")).alias("d"))
    left = asked.select("item_id", F.least(F.size(strongs("q")), F.lit(2)).alias("need"), F.explode(strongs("q")).alias("word"))
    pairs = own.select("doc_id", F.explode(strongs("d")).alias("word")).join(left, "word")
    pairs = pairs.groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need")
    scored = pairs.join(own, "doc_id").join(asked, "item_id").select("item_id", "doc_id", (F.col("hits") * 15 + F.size(F.array_intersect("q", "d")) * 2).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def fluency(turns: DataFrame, corpus: DataFrame, n: int = 3) -> DataFrame:
    """(conv_id, turn, n_grams, share): the share of a turn's n-grams that the corpus has; null for shorter turns."""
    known = grams_of_blocks(corpus, n).select(F.col("ngram").alias("gram")).distinct().withColumn("_known", F.lit(1))
    rows = turns.select("conv_id", "turn", F.explode_outer(ngrams(F.col("text"), n)).alias("gram"))
    return rows.join(known, "gram", "left").groupBy("conv_id", "turn").agg(F.count("gram").alias("n_grams"), F.round(F.sum(F.when(F.col("gram").isNotNull(), F.coalesce("_known", F.lit(0)))) / F.count("gram"), 6).alias("share"))


def link_scores(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, score) of asked pairs: 4 a direct step, and over each word between, least(steps to it, 3) times steps from it."""
    steps = grams_of_blocks(corpus, 2).groupBy("ngram").agg(F.sum("n_occurrences").alias("n"))
    # written once: direct steps, first ones and last ones all read it
    steps = cut(steps.select(F.element_at(F.split("ngram", " "), 1).alias("x"), F.element_at(F.split("ngram", " "), 2).alias("y"), "n"))
    pairs = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct()
    direct = pairs.join(steps, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("a", "b", (F.col("n") * 4).alias("part"))
    first = steps.join(pairs.select("a").distinct(), F.col("x") == F.col("a"), "left_semi").select(F.col("x").alias("a"), F.col("y").alias("m"), F.least("n", F.lit(3)).alias("n1"))
    last = steps.join(pairs.select("b").distinct(), F.col("y") == F.col("b"), "left_semi").select(F.col("x").alias("m"), F.col("y").alias("b"), F.col("n").alias("n2"))
    around = pairs.join(first, "a").join(last, ["m", "b"]).select("a", "b", (F.col("n1") * F.col("n2")).alias("part"))
    found = direct.unionByName(around).groupBy("a", "b").agg(F.sum("part").alias("score"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0)).alias("score"))


def signature_terms(documents: DataFrame, group: str, top: int = 12, least: int = 5) -> DataFrame:
    """(group, rank, term, n, share): each group's terms of the largest share of all their uses, ``least`` uses or more."""
    rows = documents.select(group, F.explode(tokens(F.col("text"))).alias("term")).groupBy(group, "term").agg(F.count("*").alias("n"))
    whole = rows.groupBy("term").agg(F.sum("n").alias("all"))
    scored = rows.where(F.col("n") >= least).join(whole, "term").withColumn("share", F.round(F.col("n") / F.col("all"), 6))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("share"), F.desc("n"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(group, "rank", "term", "n", "share")


def vote(rows: DataFrame, key: str, label: str, least: int = 3, share: float = 0.4) -> DataFrame:
    """(key, best, n, votes, decided): the most frequent label of each key, ties to the smaller; decided by number and share."""
    counts = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("k"))
    best = counts.groupBy(key).agg(F.min_by(label, F.struct(-F.col("k"), F.col(label))).alias("best"), F.max("k").alias("n"), F.sum("k").alias("votes"))
    return best.withColumn("decided", ((F.col("votes") >= least) & (F.col("n") >= share * F.col("votes"))).cast("int"))


def single_meaning(rows: DataFrame, frame: str, predicate: str, least: int = 2) -> DataFrame:
    """(frame, predicate, support): frames with exactly one predicate and ``least`` examples or more."""
    counts = rows.groupBy(frame).agg(F.min(predicate).alias(predicate), F.max(predicate).alias("_other"), F.count(predicate).alias("support"))
    return counts.where((F.col(predicate) == F.col("_other")) & (F.col("support") >= least)).select(frame, predicate, "support")


def rebuilt(postings: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): texts from (keys, word, positions), words in order of their positions."""
    places = postings.select(*keys, "word", F.explode("positions").alias("at"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "word")))
    return places.groupBy(*keys).agg(F.array_join(F.transform(in_order, lambda s: s["word"]), " ").alias("text"))


def composed(*layers: DataFrame) -> DataFrame:
    """(columns, layer, ord): rows of all layers, equal rows once, the first layer and then the least ord wins."""
    columns = [c for c in layers[0].columns if c != "ord"]
    every = layers[0].withColumn("layer", F.lit(1))
    for n, layer in enumerate(layers[1:], 2):
        every = every.unionByName(layer.withColumn("layer", F.lit(n)))
    return every.groupBy(*columns).agg(F.min(F.struct("layer", "ord")).alias("_f")).select(*columns, "_f.layer", "_f.ord")


def entities_in_window(turns: DataFrame, n: int = 3, least: int = 12) -> DataFrame:
    """(conv_id, entities): long words of the last ``n`` answered turns, each at its newest turn, oldest turn first."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.where("role != 'system' AND trim(coalesce(text, '')) != ''").withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= n)
    words = F.array_distinct(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= least))
    rows = last.select("conv_id", "turn", F.posexplode(words).alias("at", "word"))
    seen = rows.groupBy("conv_id", "word").agg(F.max(F.struct("turn", -F.col("at"))).alias("s"))
    in_order = F.array_sort(F.collect_list(F.struct(F.col("s.turn").alias("turn"), (-F.col("s.col2")).alias("at"), "word")))
    return seen.groupBy("conv_id").agg(F.array_join(F.transform(in_order, lambda s: s["word"]), " ").alias("entities"))


def cached(questions: DataFrame, cache: DataFrame, now: str, hours: int = 168, least: int = 5, longest: int = 3) -> DataFrame:
    """(columns, key): the longest live key of the cache among each question's words, ties to the smaller; null without one.

    ``cache`` is (key, fetched), plain words; a key lives for some hours and has ``least`` letters or more.
    ``questions`` has (question_id, text).
    """
    live = cache.where((F.col("fetched") + F.expr(f"INTERVAL {int(hours)} HOURS") > F.lit(now).cast("timestamp")) & (F.length("key") >= least)).select("key").distinct()
    grams = F.concat(*(ngrams(F.col("text"), n) for n in range(1, longest + 1)))
    hits = questions.select("question_id", F.explode(F.array_distinct(grams)).alias("key")).join(live, "key")
    best = hits.groupBy("question_id").agg(F.min_by("key", F.struct(-F.length("key"), F.col("key"))).alias("key"))
    return questions.select("question_id").distinct().join(best, "question_id", "left")
