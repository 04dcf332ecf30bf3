"""Acquisition and serving: cohorts, frontiers, allow-lists, exact resolution, serving overlays, gates of yield and review, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.normalize import rule_key


def work_facts(works: DataFrame) -> DataFrame:
    """(work, predicate, object): a ``created_by`` fact for each author and a ``published_by`` fact of (work, authors, publisher)."""
    authors = works.select("work", F.lit("created_by").alias("predicate"), F.explode(F.array_distinct("authors")).alias("object"))
    return authors.unionByName(works.where("publisher != ''").select("work", F.lit("published_by").alias("predicate"), F.col("publisher").alias("object")))


def with_all_predicates(facts: DataFrame, key: str, predicates: tuple[str, ...]) -> DataFrame:
    """Facts of the keys that have every one of some predicates."""
    own = facts.where(F.col("predicate").isin(*predicates)).groupBy(key).agg(F.count_distinct("predicate").alias("_n")).where(F.col("_n") == len(predicates))
    return facts.join(own.select(key), key, "left_semi")


def topic_and_reference(topics: DataFrame, references: DataFrame, titles: DataFrame) -> DataFrame:
    """(work, topic, cites): the topic of highest score (ties to the first name) and the first referenced work that has a title."""
    best = topics.groupBy("work").agg(F.max_by("topic", F.struct("score", F.lit(0))).alias("_any"), F.max("score").alias("score"))
    best = topics.join(best.select("work", "score"), ["work", "score"]).groupBy("work").agg(F.min("topic").alias("topic"))
    first = references.join(titles, references["ref"] == titles["id"]).groupBy("work").agg(F.min_by("title", "pos").alias("cites"))
    return best.join(first, "work", "full").select("work", "topic", "cites")


def serving_overlay(edges: DataFrame) -> DataFrame:
    """(kind, subject, predicate, object): distinct entities of both ends, and the distinct edges, of accepted ones."""
    good = edges.where("verdict = 'accept'")
    none = F.lit("")
    entity = lambda c: good.select(F.lit("entity").alias("kind"), F.col(c).alias("subject"), none.alias("predicate"), none.alias("object"))
    return entity("subject").unionByName(entity("object")).unionByName(good.select(F.lit("relation").alias("kind"), "subject", "predicate", "object")).distinct()


def content_properties(claims: Column, meta: tuple[str, ...], kinds: Column, content: tuple[str, ...]) -> Column:
    """Sorted property ids of a map that are neither meta ones nor of a kind that holds no content; ``kinds`` maps ids to kinds."""
    return F.array_sort(F.filter(F.map_keys(claims), lambda p: ~p.isin(*meta) & F.coalesce(F.try_element_at(kinds, p).isin(*content), F.lit(False))))


def density_frontier(relations: DataFrame, seen: DataFrame) -> DataFrame:
    """Subjects with exactly one predicate, that predicate, and their facts; subjects that were seen are left out."""
    one = relations.groupBy("subject").agg(F.count_distinct("predicate").alias("_p"), F.min("predicate").alias("predicate"), F.count("*").alias("n")).where("_p = 1").drop("_p")
    return one.join(seen.select("subject").distinct(), "subject", "left_anti")


def unique_matches(names: DataFrame, entities: DataFrame, on: str) -> DataFrame:
    """(name, id): names that exactly one entity has as its ``on``."""
    found = names.select("name").distinct().join(entities.select(F.col(on).alias("name"), "id").distinct(), "name")
    return found.groupBy("name").agg(F.count("*").alias("_n"), F.min("id").alias("id")).where("_n = 1").drop("_n")


def resolved(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, id, how): a unique exact label, else a unique exact alias, else nothing. ``entities`` is (id, label, alias)."""
    label, alias = unique_matches(names, entities, "label"), unique_matches(names, entities, "alias")
    out = names.select("name").distinct().join(label.withColumnRenamed("id", "_l"), "name", "left").join(alias.withColumnRenamed("id", "_a"), "name", "left")
    how = F.when(F.col("_l").isNotNull(), "label").when(F.col("_a").isNotNull(), "alias").otherwise("none")
    return out.select("name", F.coalesce("_l", "_a").alias("id"), how.alias("how"))


def proposals(subjects: DataFrame, claims: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(subject, predicate, object, reason): each subject's claims of known properties, or why it has none."""
    own = claims.withColumn("_ok", F.col("predicate").isin(*known))
    any_ = own.groupBy("subject").agg(F.max(F.col("_ok").cast("int")).alias("_any"))
    rows = subjects.select("subject").distinct().join(any_, "subject", "left")
    why = F.when(F.col("_any").isNull(), "no_claims").when(F.col("_any") == 0, "no_content_properties")
    none = F.lit(None).cast("string")
    missing = rows.select("subject", none.alias("predicate"), none.alias("object"), why.alias("reason")).where("reason IS NOT NULL")
    good = subjects.select("subject").distinct().join(own.where("_ok"), "subject").select("subject", "predicate", "object", F.lit("").alias("reason"))
    return good.unionByName(missing)


def seeded(frontier: DataFrame, topics: DataFrame, weight: float) -> DataFrame:
    """(title, weight): the frontier with every topic at ``weight`` or more; titles meet by key and keep the frontier's form."""
    k = rule_key(F.col("title")).alias("_k")
    old, new = frontier.select("title", "weight", k), topics.select("title", k).groupBy("_k").agg(F.min("title").alias("_t"))
    out = old.join(new, "_k", "full")
    raised = F.when(F.col("_t").isNotNull(), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(weight))).otherwise(F.col("weight"))
    return out.select(F.coalesce("title", "_t").alias("title"), raised.alias("weight"))


def allow_list(frontier: DataFrame, fetched: DataFrame, total: int, batch: int) -> DataFrame:
    """(rank, title, batch_index, fetched): the best ``total`` titles by weight, then title; fetched ones stay and are flagged.

    No more than ``total`` rows are numbered.
    """
    best = frontier.orderBy(F.desc("weight"), "title").limit(total)
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "title"))).alias("a")).select(F.posexplode("a").alias("_n", "x"))
    out = rows.select(F.col("_n").alias("rank"), "x.title", F.floor(F.col("_n") / batch).alias("batch_index"))
    flagged = fetched.select("title", F.lit(1).alias("_f")).distinct()
    return out.join(flagged, "title", "left").select("rank", "title", "batch_index", F.coalesce("_f", F.lit(0)).alias("fetched"))


def grown_frontier(frontier: DataFrame, links: DataFrame, *gone: DataFrame) -> DataFrame:
    """(title, weight): new links join the frontier, one more for each time a title is linked; titles of ``gone`` are left out."""
    new = links.select("title", F.lit(1.0).alias("weight"))
    out = frontier.select("title", "weight").unionByName(new).groupBy("title").agg(F.sum("weight").alias("weight"))
    return reduce(lambda rows, g: rows.join(g.select("title").distinct(), "title", "left_anti"), gone, out)


def usable_title(title: Column) -> Column:
    """Whether a title may be fetched: no namespace, list, number or year, neither too short nor too long."""
    low = F.lower(F.trim(title))
    return (F.length(low) >= 3) & (F.length(low) <= 80) & ~low.rlike("^(list of|category:|file:|template:|help:|portal:|wikipedia:)") & ~low.rlike("^[0-9 ]+$") & low.rlike("[a-z]")


def yield_signals(facts: DataFrame, candidates: DataFrame, history: DataFrame, most_fetches: int = 3) -> DataFrame:
    """(page, n_facts, n_candidates, n_fetches, signal): two facts or more are high yield; fetched often without any, low."""
    count = lambda rows, name: rows.groupBy("page").agg(F.count("*").alias(name))
    out = count(facts, "n_facts").join(count(candidates, "n_candidates"), "page", "full").join(count(history, "n_fetches"), "page", "full").fillna(0)
    signal = F.when(F.col("n_facts") >= 2, "high_yield").when((F.col("n_facts") == 0) & (F.col("n_fetches") >= most_fetches), "low_yield").otherwise("neutral")
    return out.withColumn("signal", signal)


def yield_gate(metrics: DataFrame, least: float, ranked: bool = True, force: bool = False) -> DataFrame:
    """Metrics with yield_per_ready, blind_unproductive, blind_fetch_allowed and ranked_fetch_recommended (0 or 1).

    ``metrics`` has facts, ready, batches, zero_batches and negative (boolean).
    """
    per = F.when(F.col("ready") > 0, F.col("facts") / F.col("ready")).otherwise(0.0)
    bad = F.col("negative") | ((F.col("batches") > 0) & (F.col("zero_batches") >= F.col("batches"))) | (per < least)
    return metrics.withColumns({"yield_per_ready": F.round(per, 6), "blind_unproductive": bad.cast("int"), "blind_fetch_allowed": (~bad | F.lit(force)).cast("int"), "ranked_fetch_recommended": (bad & F.lit(ranked)).cast("int")})


def review_issues(items: DataFrame) -> DataFrame:
    """(item_id, severity, code): one row for each issue of an item of (item_id, kind, subject, object, source_page, evidence, stability, as_of, strength)."""
    repeated = items.groupBy("kind", "subject", "object").agg(F.min("item_id").alias("_first"))
    rows = items.join(repeated, ["kind", "subject", "object"])
    kind = F.col("kind")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issue = lambda when, severity, code: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code")))
    found = F.array(
        issue(F.col("item_id") != F.col("_first"), "warning", "duplicate_candidate"),
        issue((kind == "context_link") & (F.col("strength") != "weak"), "error", "context_link_not_weak"),
        issue((kind != "context_link") & blank("source_page"), "error", "missing_source"),
        issue((kind == "entity") & blank("subject"), "error", "entity_card_no_label"),
        issue((kind == "relation") & blank("evidence"), "error", "missing_evidence"),
        issue((kind == "relation") & (blank("subject") | blank("object")), "error", "relation_empty_field"),
        issue((kind == "source_fact") & blank("as_of"), "error", "source_fact_without_as_of"),
        issue((kind == "definition") & (blank("subject") | blank("object")), "error", "definition_empty_field"),
    )
    return rows.select("item_id", F.explode(F.array_compact(found)).alias("i")).select("item_id", "i.severity", "i.code")


def normalized_facts(facts: DataFrame, cues: tuple[str, ...]) -> DataFrame:
    """(term, sense, fact_type, value, risk, status): the same term, type and value under another sense is a conflict of high risk; values with a broad cue are rejected."""
    keys = ["term", "fact_type", "value"]
    senses = facts.groupBy(*keys).agg(F.count_distinct("sense").alias("_n"))
    conflict, broad = F.col("_n") > 1, F.col("value").isin(*cues)
    status = F.when(broad, "rejected").when(conflict, "conflict").otherwise("accepted")
    return facts.join(senses, keys).select("term", "sense", "fact_type", "value", F.when(conflict, "high").otherwise("low").alias("risk"), status.alias("status"))


def memory_review(items: DataFrame) -> DataFrame:
    """Items with a decision: conflicts and high risk need review, volatile or unsourced ones are rejected, the rest is accepted."""
    decision = F.when((F.col("stability") == "volatile") | (F.coalesce("source_page", F.lit("")) == ""), "reject").when((F.col("risk") == "high") | (F.col("status") == "conflict"), "needs_review").otherwise("accept_auto")
    return items.withColumn("decision", decision)


def overlay_items(candidates: DataFrame) -> DataFrame:
    """(item_id, overlay_type, skipped): the type of each candidate's item, or why there is none."""
    type_ = F.when(F.col("kind") == "entity", "overlay_entity").when(F.col("kind") == "definition", "overlay_definition").when(F.col("kind") == "relation", "overlay_relation").when(F.col("kind") == "context_link", "overlay_context_link")
    skip = F.when(type_.isNull(), "unsupported_kind").when(F.coalesce("subject", F.lit("")) == "", "empty_subject").when((F.col("kind") == "relation") & ((F.col("confidence") == "low") | (F.col("stability") == "volatile")), "unsafe_relation")
    return candidates.select("item_id", F.when(skip.isNull(), type_).alias("overlay_type"), F.coalesce(skip, F.lit("")).alias("skipped"))


def full_name_aliases(definitions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities whose aliases begin with the three-part name that a definition of their page gives, if it begins and ends as the label."""
    named = definitions.select("page", F.regexp_extract("definition", r"^([A-Z][a-z]+ [A-Z][a-z.]+ [A-Z][a-z]+)\b", 1).alias("_full")).where("_full != ''").groupBy("page").agg(F.min("_full").alias("_full"))
    out = entities.join(named, "page", "left")
    words, label = F.split("_full", " "), F.split("label", " ")
    fits = (F.size(label) == 2) & (F.get(words, F.lit(0)) == F.get(label, F.lit(0))) & (F.get(words, F.lit(2)) == F.get(label, F.lit(1)))
    return out.withColumn("aliases", F.when(F.coalesce(fits, F.lit(False)), F.array_distinct(F.array_prepend("aliases", F.col("_full")))).otherwise(F.col("aliases"))).drop("_full")


def evidence_grade(sources: Column, stability: Column, risk: Column) -> Column:
    """Struct of what a relation's evidence allows: corroborated, queryable, tier."""
    good = (stability != "volatile") & (risk != "high")
    tier = F.when(good & (sources > 1), "corroborated").when(good, "single_source").otherwise("withheld")
    return F.struct((sources > 1).alias("corroborated"), good.alias("queryable"), tier.alias("tier"))


def coalesced_entities(entities: DataFrame) -> DataFrame:
    """(label, aliases, support): all aliases of a label, shortest first, then by name, and the sum of supports."""
    rows = entities.groupBy("label").agg(F.sum("support").alias("support"), F.collect_set("alias").alias("_a"))
    order = F.array_sort(F.transform("_a", lambda a: F.struct(F.length(a).alias("n"), F.lower(a).alias("l"), a.alias("a"))))
    return rows.select("label", F.transform(order, lambda x: x["a"]).alias("aliases"), "support")


def top_by(rows: DataFrame, measures: tuple[str, ...], key: str, top: int) -> DataFrame:
    """(measure, rank, key, value): the best rows of each measure, ties by key; no more than ``top`` are numbered."""
    parts = []
    for m in measures:
        best = rows.orderBy(F.desc(m), key).limit(top).agg(F.array_sort(F.collect_list(F.struct((-F.col(m)).alias("v"), F.col(key).alias("k")))).alias("a"))
        parts.append(best.select(F.lit(m).alias("measure"), F.posexplode("a").alias("_n", "x")).select("measure", (F.col("_n") + 1).alias("rank"), F.col("x.k").alias(key), (-F.col("x.v")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def failure_stage(found: Column, resolved: Column, supported: Column, rendered: Column) -> Column:
    """The earliest stage that failed."""
    return F.when(~found, "entity_not_found").when(~resolved, "relation_not_resolved").when(~supported, "no_supported_fact").when(~rendered, "not_rendered").otherwise("passed")


def role_holders(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """(anchor, relation, holder): what an anchor points at by a relation, and what points at it; each once."""
    own = asked.select("anchor", "relation").distinct()
    one = own.join(facts, (F.col("anchor") == F.col("subject")) & (F.col("relation") == F.col("predicate"))).select("anchor", "relation", F.col("object").alias("holder"))
    two = own.join(facts, (F.col("anchor") == F.col("object")) & (F.col("relation") == F.col("predicate"))).select("anchor", "relation", F.col("subject").alias("holder"))
    return one.unionByName(two).distinct()


def first_titles(rows: DataFrame, top: int) -> DataFrame:
    """(title, ord): the first of each title by key, in order, ``top`` at most."""
    k = rule_key(F.col("title"))
    return rows.groupBy(k.alias("_k")).agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord")).orderBy("ord").limit(top).select("title", "ord")


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows with ``rank`` within each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
