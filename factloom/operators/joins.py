"""Joins over facts: resolution of surfaces, connections and bridges, deltas, provenance, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.normalize import hop_key, lookup_key, rule_key
from factloom.functions.policy import hop_safe

KEYS = ("subject", "predicate", "object")


def resolve(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(surface, entity_id, how): the first hit of exact label, exact alias, label key, alias key, page key (how 1 to 5).

    ``entities`` is (ord, entity_id, label, aliases, page); names are reduced to their first
    entity before the join, so a name that many entities share makes one row. Surfaces
    without a hit, and nulls, have no row.
    """
    named = lambda how, key: F.struct(F.lit(how).cast("long").alias("how"), key.alias("key"))
    own = F.array(named(1, F.col("label")), named(3, lookup_key(F.col("label"))), named(5, lookup_key(F.col("page"))))
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    every = F.concat(own, F.transform(aliases, lambda a: named(2, a)), F.transform(aliases, lambda a: named(4, lookup_key(a))))
    names = entities.select("ord", "entity_id", F.explode(every).alias("n")).select("ord", "entity_id", "n.how", "n.key").where("key != ''")
    names = names.groupBy("how", "key").agg(F.min_by("entity_id", "ord").alias("entity_id"))
    surface = F.col("surface")
    asked = F.array(*(named(how, surface if how < 3 else lookup_key(surface)) for how in range(1, 6)))
    asked = mentions.select("surface").distinct().select("surface", F.explode(asked).alias("n")).select("surface", "n.how", "n.key")
    return asked.join(names, ["how", "key"]).groupBy("surface").agg(F.min_by("entity_id", "how").alias("entity_id"), F.min("how").alias("how"))


def connections(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, c, direction, status, via) of every pair: its first two-hop path from a to c, else from c to a.

    The first path by load order decides: ``blocked`` where one of its hops is unsafe, no
    later path is tried. Pairs without a path are ``audit``. Only paths of asked pairs are joined.
    """
    hops = facts.select(hop_key(F.col("subject")).alias("_s"), hop_key(F.col("object")).alias("_o"), "object", "ord", hop_safe().alias("_safe"))
    ways = F.array(
        F.struct(F.lit("forward").alias("direction"), hop_key(F.col("a")).alias("start"), hop_key(F.col("c")).alias("end")),
        F.struct(F.lit("reverse").alias("direction"), hop_key(F.col("c")).alias("start"), hop_key(F.col("a")).alias("end")),
    )
    pairs = pairs.select("a", "c").distinct()
    asked = pairs.select("a", "c", F.explode(ways).alias("w")).select("a", "c", "w.*")
    one = hops.select(F.col("_s").alias("start"), F.col("_o").alias("_mid"), F.col("object").alias("via"), F.col("ord").alias("_ord1"), F.col("_safe").alias("_safe1"))
    two = hops.select(F.col("_s").alias("_mid"), F.col("_o").alias("end"), F.col("ord").alias("_ord2"), F.col("_safe").alias("_safe2"))
    paths = asked.join(one, "start").join(two, ["_mid", "end"])
    status = F.when(F.col("_safe1") & F.col("_safe2"), "answer").otherwise("blocked")
    found = paths.groupBy("a", "c").agg(F.min_by(F.struct("direction", status.alias("status"), "via"), F.struct("direction", "_ord1", "_ord2")).alias("p"))
    out = pairs.join(found, ["a", "c"], "left")
    return out.select("a", "c", "p.direction", F.coalesce("p.status", F.lit("audit")).alias("status"), "p.via")


#: Parts among which the ways into one node are dealt.
_SALTS = 64


def through(facts: DataFrame, via: str) -> DataFrame:
    """(subject, object): ends of safe two-hop paths through one node.

    Every way in meets every way out; the ways in are dealt over salts, and the ways out go to each salt.
    """
    safe = facts.where(hop_safe())
    into = safe.where(hop_key(F.col("object")) == hop_key(F.lit(via))).select("subject").distinct()
    out = safe.where(hop_key(F.col("subject")) == hop_key(F.lit(via))).select("object").distinct()
    salt = F.pmod(F.xxhash64("subject"), F.lit(_SALTS))
    spread = out.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    return into.withColumn("_k", salt).join(spread, "_k").select("subject", "object")


def bridges(facts: DataFrame, pairs: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """(subject, object, status, bridge) of every pair, over undirected facts.

    ``direct`` where a fact links them, ``speculative`` with the best node between them
    (first hop's predicate by ``priority``, then load order, then the node), else ``audit``.
    """
    rank = F.lit(9)
    for predicate, value in (priority or {}).items():
        rank = F.when(F.col("predicate") == predicate, value).otherwise(rank)
    s, o = rule_key(F.col("subject")), rule_key(F.col("object"))
    edge = lambda x, y, name: facts.select(x.alias("_x"), y.alias("_y"), F.col(name).alias("_name"), rank.alias("_rank"), "ord")
    edges = edge(s, o, "object").unionAll(edge(o, s, "subject")).where("_x != _y")
    pairs = pairs.select("subject", "object").distinct().withColumns({"_s": s, "_o": o})
    direct = pairs.join(edges.select(F.col("_x").alias("_s"), F.col("_y").alias("_o")).distinct(), ["_s", "_o"], "left_semi").select("subject", "object", F.lit(1).alias("_direct"))
    first = edges.select(F.col("_x").alias("_s"), F.col("_y").alias("_m"), F.col("_name").alias("bridge"), "_rank", "ord")
    second = edges.select(F.col("_x").alias("_m"), F.col("_y").alias("_o")).distinct()
    between = pairs.join(first, "_s").where("_m != _o").join(second, ["_m", "_o"])
    best = between.groupBy("subject", "object").agg(F.min_by("bridge", F.struct("_rank", "ord", "_m")).alias("bridge"))
    out = pairs.select("subject", "object").join(direct, ["subject", "object"], "left").join(best, ["subject", "object"], "left")
    status = F.when(F.col("_direct") == 1, "direct").when(F.col("bridge").isNotNull(), "speculative").otherwise("audit")
    return out.select("subject", "object", status.alias("status"), F.when(status == "speculative", F.col("bridge")).alias("bridge"))


def shared_facts(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, predicate, object): distinct safe facts that both of a pair have, objects compared by key."""
    own = facts.where(hop_safe()).select("subject", "predicate", "object", rule_key(F.col("object")).alias("_k"))
    left = pairs.join(own.withColumnRenamed("subject", "a"), "a")
    right = own.select(F.col("subject").alias("b"), "predicate", "_k").distinct()
    return left.join(right, ["b", "predicate", "_k"], "left_semi").select("a", "b", "predicate", "object").distinct()


def with_inverse(facts: DataFrame, predicate: str, inverse: str) -> DataFrame:
    """Distinct (subject, object) of a predicate and, turned round, of its inverse."""
    turned = facts.where(F.col("predicate") == inverse).select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    return facts.where(F.col("predicate") == predicate).select("subject", "object").unionByName(turned).distinct()


def new_items(candidates: DataFrame, base: DataFrame, inverses: dict[str, str]) -> DataFrame:
    """Candidates that are not in ``base``, neither as such nor turned round; the first by ``ord`` of each key stays."""
    key = lambda x, p, y: F.struct(rule_key(F.col(x)).alias("s"), p.alias("p"), rule_key(F.col(y)).alias("o"))
    turn = F.create_map(*(F.lit(x) for kv in inverses.items() for x in kv)) if inverses else F.lit(None).cast("map<string,string>")
    known = base.select(F.explode(F.array(key("subject", F.col("predicate"), "object"), key("object", F.try_element_at(turn, F.col("predicate")), "subject"))).alias("_k")).where("_k.p IS NOT NULL")
    rows = candidates.withColumn("_k", key("subject", F.col("predicate"), "object"))
    first = rows.join(known.distinct(), "_k", "left_anti").groupBy("_k").agg(F.min_by(F.struct(*candidates.columns), "ord").alias("r"))
    return first.select("r.*")


def classified_delta(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """Adds ``status``: duplicate, conflict, tainted or new.

    ``items`` has (source, subject, predicate, object), ``accepted`` one object for each
    subject and predicate. A source with a conflict taints all else that it brings.
    """
    known = accepted.select("subject", "predicate", F.col("object").alias("_known"))
    rows = items.join(known, ["subject", "predicate"], "left")
    clash = F.col("_known").isNotNull() & (F.col("_known") != F.col("object"))
    bad = rows.where(clash).select("source").distinct().withColumn("_bad", F.lit(True))
    status = F.when(clash, "conflict").when(F.col("_bad"), "tainted").when(F.col("_known").isNotNull(), "duplicate").otherwise("new")
    return rows.join(bad, "source", "left").select(*items.columns, status.alias("status"))


def first_attribution(facts: DataFrame, fetches: DataFrame, key: str, place: str) -> DataFrame:
    """Facts with the earliest ``place`` at which their key was fetched, null where it never was."""
    return facts.join(fetches.groupBy(key).agg(F.min(place).alias(f"first_{place}")), key, "left")


def one_hop(facts: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct safe facts that touch a neighbour of the matched entities but none of these themselves."""
    safe = facts.where(hop_safe()).select(*KEYS).distinct()
    hit = matched.select(F.col("entity").alias("_e")).distinct()
    near = lambda column: safe.join(hit, F.col(column) == F.col("_e")).drop("_e")
    around = near("subject").select(F.col("object").alias("_e")).union(near("object").select("subject")).distinct().join(hit, "_e", "left_anti")
    touch = lambda rows, column, kind: rows.join(around if kind == "left_semi" else hit, F.col(column) == F.col("_e"), kind)
    out = touch(safe, "subject", "left_semi").union(touch(safe, "object", "left_semi")).distinct()
    return touch(touch(out, "subject", "left_anti"), "object", "left_anti")


def clean_groups(rows: DataFrame, seen: DataFrame, group: str, member: str) -> DataFrame:
    """(group, n): groups of which no member was seen, with their sizes."""
    dirty = rows.join(seen.select(member).distinct(), member, "left_semi").select(group).distinct()
    return rows.join(dirty, group, "left_anti").groupBy(group).agg(F.count("*").alias("n"))


def alias_forms(facts: DataFrame) -> DataFrame:
    """(subject, predicate, canonical, n_forms, n, kept): objects of one subject and predicate that differ only in form."""
    rows = facts.groupBy("subject", "predicate", lookup_key(F.col("object")).alias("canonical"))
    out = rows.agg(F.count_distinct("object").alias("n_forms"), F.count("*").alias("n"), F.min("object").alias("kept"))
    return out.where("n_forms > 1")


def top_rows(rows: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows of each group, with their ``rank``; a report of the best, not a filter of the data."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= keep)


def definitions(entities: DataFrame, known: DataFrame) -> DataFrame:
    """(entity_id, definition, score): the best definition of each entity.

    ``entities`` is (entity_id, label, aliases, page), ``known`` (ord, subject, definition, page).
    A subject that is the label or page gives 100, the first definition of the entity's page 80
    (later ones give less and never win), an alias 10. Ties go to the least ord; entities without any have no row.
    """
    rows = known.select("ord", "definition", lookup_key(F.col("subject")).alias("key"), lookup_key(F.col("page")).alias("_page"))
    first = rows.groupBy("key").agg(F.min_by(F.struct("ord", "definition"), "ord").alias("d"))
    paged = rows.where("_page != ''").groupBy(F.col("_page").alias("key")).agg(F.min_by(F.struct("ord", "definition"), "ord").alias("d"))
    name = lambda c, points: F.struct(lookup_key(c).alias("key"), F.lit(points).alias("score"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: name(a, 10))
    asked = entities.select("entity_id", F.explode(F.concat(F.array(name(F.col("label"), 100), name(F.col("page"), 100)), aliases)).alias("n"))
    direct = asked.select("entity_id", "n.key", "n.score").where("key != ''").join(first, "key").select("entity_id", "score", "d")
    near = entities.select("entity_id", lookup_key(F.col("page")).alias("key")).where("key != ''").join(paged, "key").select("entity_id", F.lit(80).alias("score"), "d")
    best = direct.unionByName(near).groupBy("entity_id").agg(F.max_by(F.struct("d", "score"), F.struct("score", -F.col("d.ord"))).alias("b"))
    return best.select("entity_id", "b.d.definition", F.col("b.score").cast("long").alias("score"))


def membership(asked: DataFrame, reach: DataFrame, direct: DataFrame, groups: DataFrame) -> DataFrame:
    """(subject, class, verdict): ``yes`` by a path, ``no`` where a class of the subject is of another group, else ``audit``.

    ``reach`` and ``direct`` are (subject, object), ``groups`` (class, group) with one group a class.
    """
    asked = asked.select("subject", "class").distinct()
    yes = reach.select("subject", F.col("object").alias("class")).distinct().withColumn("_yes", F.lit(True))
    own = direct.join(groups, F.col("object") == F.col("class")).select("subject", F.col("group").alias("_own")).distinct()
    other = asked.join(groups, "class").join(own, "subject").where("group != _own").select("subject", "class").distinct().withColumn("_no", F.lit(True))
    out = asked.join(yes, ["subject", "class"], "left").join(other, ["subject", "class"], "left")
    return out.select("subject", "class", F.when(F.col("_yes"), "yes").when(F.col("_no"), "no").otherwise("audit").alias("verdict"))


def one_to_one(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, status): ``matched`` once on each side, ``repeated``, ``missing`` without a result, ``extra`` without a case."""
    count = lambda rows, name: rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))
    both = count(cases, "_a").join(count(results, "_b"), key, "full")
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated").otherwise("matched")
    return both.select(key, status.alias("status"))


def weighted_pick(options: DataFrame, seed: str) -> DataFrame:
    """(src, dst): one option of each source, drawn by weight from a hash of seed and source, the same in every run."""
    order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst").rowsBetween(Window.unboundedPreceding, 0)
    drawn = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), "src"), "UTF-8"), 256), 1, 12), 16, 10).cast("long")
    rows = options.where("weight > 0").withColumn("_to", F.sum("weight").over(order)).withColumn("_all", F.sum("weight").over(Window.partitionBy("src")))
    pick = drawn % F.col("_all")
    return rows.where((pick < F.col("_to")) & (pick >= F.col("_to") - F.col("weight"))).select("src", "dst")


def cohort(rows: DataFrame, key: str, predicate: str, title: str, wanted: list[str]) -> DataFrame:
    """(title, key): keys that hold all wanted predicates; of equal titles the key whose SHA-256 is least stays."""
    has = [F.max((F.col(predicate) == p).cast("int")).alias(f"_{n}") for n, p in enumerate(wanted)]
    whole = rows.where(F.col(title).isNotNull()).groupBy(title, key).agg(*has).where(" AND ".join(f"_{n} = 1" for n in range(len(wanted))))
    return whole.groupBy(title).agg(F.min_by(key, F.sha2(F.col(key).cast("string").cast("binary"), 256)).alias(key))


def capped_evidence(facts: DataFrame, by: list[str], keep: int) -> DataFrame:
    """(by, support, evidence): the number of facts of each group and its first ``keep`` subjects in order, ``|`` between them.

    Subjects are ranked before they are collected, so no group is collected whole.
    """
    few = top_rows(facts.select(*by, "subject").distinct(), by, [F.col("subject")], keep)
    few = few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "subject"))), lambda s: s["subject"]), "|").alias("evidence"))
    return facts.groupBy(*by).agg(F.count("*").alias("support")).join(few, by)
