"""Lookups, bridges and explanations over facts: filters, fallback chains, provenance, walks and bounded expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.lineage import cut
from factloom.functions.normalize import lookup_key, rule_key

# Words that only point, broad topics, abstract places, class groups that exclude each other.
POINTING = ("our", "my", "we", "us", "i", "this", "these", "those", "that")
BARE = ("it", "its", "we", "us", "the", "they", "them", "this", "these", "those")
BROAD_TOPICS = ("technology", "company", "science", "software", "internet", "business", "economy", "energy", "ai")
ABSTRACT_PLACES = ("area", "region", "country", "city", "market", "world", "industry")


def lookup(rows: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns have the wanted values, compared by lookup key; None matches all. Catalyst orders the filters."""
    for column, value in wanted.items():
        rows = rows if value is None else rows.where(lookup_key(F.col(column)) == lookup_key(F.lit(value)))
    return rows


def is_named(name: Column) -> Column:
    """Whether a node names something: it is no bare pronoun and doesn't begin with a pointing word."""
    own = rule_key(F.coalesce(name, F.lit("")))
    return (own != "") & ~own.isin(*BARE) & ~F.split(own, " ")[0].isin(*POINTING)


def bad_location(subject: Column, object_: Column, page: Column) -> Column:
    """Whether a place is not to be shown: told on another page, or abstract."""
    return (rule_key(page) != rule_key(subject)) | rule_key(object_).isin(*ABSTRACT_PLACES)


def unsafe_alias(alias: Column, label: Column, type_: Column) -> Column:
    """Whether an alias is a broad topic, or just the last word of a longer label of something other than a person."""
    words = F.split(rule_key(label), " ")
    return rule_key(alias).isin(*BROAD_TOPICS) | ((F.size(words) > 1) & (F.element_at(words, -1) == rule_key(alias)) & (type_ != "person"))


def allowed_only(rows: DataFrame, column: str, allowed: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Rows of allowed nodes; an excluded one in the list of allowed ones is an error, raised where it is met."""
    guard = F.when(F.col(column).isin(*excluded), F.raise_error(F.lit("an excluded node is allowed")).cast("boolean")).otherwise(F.lit(True))
    return rows.join(allowed.select(column).distinct().where(guard), column, "left_semi")


def contradictions(facts: DataFrame, asked: DataFrame, groups: DataFrame) -> DataFrame:
    """(subject, class, basis): asked (subject, class) pairs that a known class of another group contradicts.

    ``groups`` is (class, grp); classes without a group contradict nothing. The basis is the first such class.
    """
    known = facts.where("predicate = 'is_a'").select("subject", F.col("object").alias("class")).join(groups, "class").select("subject", F.col("class").alias("basis"), F.col("grp").alias("_g"))
    own = asked.select("subject", "class").distinct().join(groups, "class")
    return own.join(known, "subject").where("grp != _g").groupBy("subject", "class").agg(F.min("basis").alias("basis"))


def typed_two_hop(facts: DataFrame, first: str, category: str) -> DataFrame:
    """(subject, via): subjects with a ``first`` fact about something of a class; no safety check, as for typed paths."""
    one = facts.where(F.col("predicate") == first).select("subject", F.col("object").alias("via"), lookup_key(F.col("object")).alias("_k"))
    kinds = facts.where((F.col("predicate") == "is_a") & (lookup_key(F.col("object")) == lookup_key(F.lit(category))))
    return one.join(kinds.select(lookup_key(F.col("subject")).alias("_k")).distinct(), "_k", "left_semi").select("subject", "via")


def fallback_bridge(pairs: DataFrame, *sources: tuple[str, DataFrame]) -> DataFrame:
    """(a, b, how, via): each pair by the first source that knows it, else ``audit``; a source is (a, b, via).

    Of several ways of one source the first in order is taken.
    """
    out = pairs.select("a", "b").distinct()
    found = []
    for n, (name, rows) in enumerate(sources):
        own = rows.groupBy("a", "b").agg(F.min("via").alias(f"_v{n}"))
        out = out.join(own, ["a", "b"], "left")
        found.append(F.when(F.col(f"_v{n}").isNotNull(), F.struct(F.lit(name).alias("how"), F.col(f"_v{n}").alias("via"))))
    best = F.coalesce(*found, F.struct(F.lit("audit").alias("how"), F.lit(None).cast("string").alias("via")))
    return out.withColumn("_b", best).select("a", "b", "_b.how", "_b.via")


def without_facts(inferred: DataFrame, removed: DataFrame) -> DataFrame:
    """Inferred facts whose chain holds none of the removed (subject, predicate, object); ``chain`` is an array of such triples."""
    steps = inferred.select("id", F.explode("chain").alias("c")).select("id", "c.*")
    gone = steps.join(removed.select("subject", "predicate", "object").distinct(), ["subject", "predicate", "object"], "left_semi").select("id").distinct()
    return inferred.join(gone, "id", "left_anti")


def conferred(facts: DataFrame, focal: DataFrame) -> DataFrame:
    """(focal, n_as_subject, n_as_object): facts that name something whose existence a removed fact confers."""
    ends = F.array(F.struct(F.col("subject").alias("focal"), F.lit(1).alias("s"), F.lit(0).alias("o")), F.struct(F.col("object").alias("focal"), F.lit(0).alias("s"), F.lit(1).alias("o")))
    named = facts.select(F.explode(ends).alias("e")).select("e.*")
    return named.join(focal.select("focal").distinct(), "focal").groupBy("focal").agg(F.sum("s").alias("n_as_subject"), F.sum("o").alias("n_as_object"))


def walks(facts: DataFrame, asked: DataFrame, predicates: tuple[str, ...], depth: int = 4) -> DataFrame:
    """(subject, object, hops, closing): least hops from each asked fact's object, along some predicates, to a node its subject names by another fact.

    Nodes that were reached before are not walked again; ties go to the first node in order.
    """
    steps = cut(facts.where(F.col("predicate").isin(*predicates)).select(rule_key(F.col("subject")).alias("_from"), rule_key(F.col("object")).alias("_to")).distinct())
    own = asked.select(rule_key(F.col("subject")).alias("subject"), rule_key(F.col("object")).alias("object")).distinct()
    back = facts.select(rule_key(F.col("subject")).alias("subject"), rule_key(F.col("object")).alias("node")).distinct()
    front = cut(own.withColumn("node", F.col("object")))
    seen, closed = front, None
    for hops in range(1, depth + 1):
        new = front.join(steps, F.col("node") == F.col("_from")).select("subject", "object", F.col("_to").alias("node")).where("node != subject").distinct()
        front = cut(new.join(seen, ["subject", "object", "node"], "left_anti"))
        hit = front.join(back, ["subject", "node"], "left_semi").groupBy("subject", "object").agg(F.min("node").alias("closing")).withColumn("hops", F.lit(hops))
        hit = cut(hit)
        closed = hit if closed is None else closed.unionByName(hit)
        front = front.join(hit.select("subject", "object"), ["subject", "object"], "left_anti")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return closed.select("subject", "object", "hops", "closing")


def explained(asked: DataFrame, facts: DataFrame, inferred: DataFrame, walked: DataFrame) -> DataFrame:
    """(subject, predicate, object, status, decision): direct facts are answers if a walk explains them, else partial; inferred ones are answers; others audits."""
    keys = ["subject", "predicate", "object"]
    normal = lambda df: df.select(*(rule_key(F.col(k)).alias(k) for k in keys)).distinct()
    out = normal(asked).join(normal(facts).withColumn("_d", F.lit(1)), keys, "left").join(normal(inferred).withColumn("_i", F.lit(1)), keys, "left")
    out = out.join(walked.select("subject", "object", F.lit(1).alias("_w")).distinct(), ["subject", "object"], "left")
    status = F.when(F.col("_d").isNotNull(), "direct").when(F.col("_i").isNotNull(), "inferred").otherwise("absent")
    decision = F.when(F.col("_d").isNotNull(), F.when(F.col("_w").isNotNull(), "answer").otherwise("partial")).when(F.col("_i").isNotNull(), "answer").otherwise("audit")
    return out.select(*keys, status.alias("status"), decision.alias("decision"))


def expanded(seeds: DataFrame, parents: DataFrame, depth: int = 3, most: int = 5) -> DataFrame:
    """(child, parent, level): class edges above the seeds, level by level; of a node no more than its first ``most`` parents in order, no node twice."""
    few = parents.groupBy("child").agg(F.slice(F.array_sort(F.collect_set("parent")), 1, most).alias("p")).select("child", F.explode("p").alias("parent"))
    few = cut(few)
    front = cut(seeds.select(F.col("label").alias("child")).distinct())
    seen, out = front, None
    for level in range(1, depth + 1):
        edges = cut(front.join(few, "child").withColumn("level", F.lit(level)))
        out = edges if out is None else out.unionByName(edges)
        front = cut(edges.select(F.col("parent").alias("child")).distinct().join(seen, "child", "left_anti"))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return out


def support_kind(rows: DataFrame, key: str) -> DataFrame:
    """(key, support_kind): ``semi_stable_relation`` where any row of a result is semi-stable, else ``stable_relation``."""
    some = F.max(F.when(F.col("stability") == "semi_stable", 1).otherwise(0)) == 1
    return rows.groupBy(key).agg(F.when(some, "semi_stable_relation").otherwise("stable_relation").alias("support_kind"))


def coerced(relation: Column, actor_first: Column) -> Column:
    """``founded_by`` becomes ``founded`` where the entity is the actor."""
    return F.when((relation == "founded_by") & actor_first, "founded").otherwise(relation)


# How well an edge is attached to a node, the least number of shared words, and their least share.
CONNECTIVITY = {"exact": 1.0, "contained": 0.75, "soft": 0.55}
LEAP = {"exact": 0.0, "contained": 0.15, "soft": 0.30}
SHARED_WORDS, SHARED_RATIO = 2, 0.75


def _words(text: Column) -> Column:
    """Distinct words of three letters or more, in order of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(rule_key(text), "[^a-z0-9]+", " "), " "), lambda w: F.length(w) > 2)))


def _shared_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(*left, *right, k): pairs of distinct texts that share two words or more, and how many.

    Both sides have an array of words, ``_nw`` and ``_sw``, in order. Pairs meet by two words, not by one, so a word that all texts
    hold forms no pairs by itself; each pair counts where its first two shared words meet.
    """
    pairs = lambda w: F.flatten(F.transform(w, lambda a, i: F.transform(F.slice(w, i + 2, F.greatest(F.size(w), F.lit(1))), lambda b: F.concat_ws(" ", a, b))))
    own = left.withColumn("_two", F.explode(pairs(F.col("_nw"))))
    met = own.join(right.withColumn("_two", F.explode(pairs(F.col("_sw")))), "_two").withColumn("_both", F.array_intersect("_nw", "_sw"))
    return met.where(F.col("_two") == F.array_join(F.slice("_both", 1, 2), " ")).withColumn("k", F.size("_both")).drop("_two", "_both")


def attachments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, edge_id, mode, ratio): edges at a node: its exact name, its name of several words contained in a side, or enough shared words.

    ``nodes`` is (node), ``edges`` (edge_id, subject, object). Names meet names, each distinct side once however many edges have it;
    edges join the few (node, side) that hold at the end. Exact names of one word meet by name.
    """
    node = nodes.select(rule_key(F.col("node")).alias("node")).distinct()
    sides = F.array(*(rule_key(F.col(c)) for c in ("subject", "object")))
    edge = edges.select("edge_id", F.explode(F.array_distinct(sides)).alias("side"))
    side = edge.select("side").distinct()
    exact = side.join(node, F.col("side") == F.col("node")).select("node", "side", F.lit("exact").alias("mode"), F.lit(1.0).alias("ratio"))
    shared = _shared_words(node.withColumn("_nw", _words(F.col("node"))), side.withColumn("_sw", _words(F.col("side"))))
    ratio = F.round(F.col("k") / F.least(F.size("_nw"), F.size("_sw")), 6)
    inside = F.contains(F.concat(F.lit(" "), F.col("side"), F.lit(" ")), F.concat(F.lit(" "), F.col("node"), F.lit(" ")))
    mode = F.when(inside, "contained").when(ratio >= SHARED_RATIO, "soft")
    other = shared.select("node", "side", mode.alias("mode"), ratio.alias("ratio")).where("mode IS NOT NULL")
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in CONNECTIVITY.items() for x in kv)), F.col("mode"))
    found = edge.join(exact.unionByName(other), "side")
    return found.groupBy("node", "edge_id").agg(F.max_by(F.struct("mode", "ratio"), F.struct(rank, "ratio")).alias("b")).select("node", "edge_id", "b.mode", "b.ratio")


def posting_frontier(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_edges): edges that share two words or more with a node; edges of the same words are one row with their number."""
    told = edges.select("edge_id", _words(F.concat_ws(" ", "subject", "object")).alias("_sw"))
    # an edge of several rows has the words of all of them
    told = told.groupBy("edge_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_sw")))).alias("_sw")).groupBy("_sw").agg(F.count("*").alias("_edges"))
    hits = _shared_words(nodes.select("node").distinct().withColumn("_nw", _words(F.col("node"))), told)
    return hits.groupBy("node").agg(F.sum("_edges").alias("n_edges"))


# Weights of a candidate's score, and the qualities of a fact.
WEIGHTS = {"relevance": 0.25, "quality": 0.20, "corroboration": 0.10, "connectivity": 0.20, "gain": 0.25, "diversity": 0.10, "redundancy": -0.25, "leap": -0.50}
STABILITY_QUALITY = {"stable": 0.30, "semi_stable": 0.20}
RISK_QUALITY = {"low": 0.30, "": 0.15, "medium": 0.15}


def candidate_score(question: Column, terms: Column, payload: Column, covered: Column, stability: Column, risk: Column, n_sources: Column, mode: Column) -> Column:
    """Weighted score of an evidence edge for a question; the arrays hold distinct words."""
    pick = lambda column, table, other: reduce(lambda w, kv: w.when(column == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(other)
    overlap = F.size(F.array_intersect(question, terms))
    relevance = F.when(F.size(question) > 0, F.least(F.lit(1.0), overlap / F.greatest(F.least(F.size(question), F.size(terms)), F.lit(1)))).otherwise(0.0)
    quality = F.least(F.lit(1.0), 0.40 + pick(stability, STABILITY_QUALITY, 0.05) + pick(risk, RISK_QUALITY, 0.0))
    gain = F.size(F.array_except(payload, covered)) / F.greatest(F.size(payload), F.lit(1))
    parts = {"relevance": relevance, "quality": quality, "corroboration": F.when(n_sources > 1, 1.0).otherwise(0.5), "connectivity": pick(mode, CONNECTIVITY, 0.45), "gain": gain, "diversity": F.lit(1.0), "redundancy": 1.0 - gain, "leap": pick(mode, LEAP, 0.30)}
    return F.round(reduce(lambda a, b: a + b, (F.lit(WEIGHTS[name]) * part for name, part in parts.items())), 6)
