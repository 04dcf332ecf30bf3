"""Data-defined inference rules compiled to joins, and pattern mining over classes.

A rule's body patterns become joins on their shared variables, its ``unless`` patterns anti-joins,
its head one projection. Rules run once, over the stored facts, not over each other's results.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.normalize import rule_key

# Scores of a fact's stability.
STABILITY = {"stable": 1.0, "semi_stable": 0.7, "volatile": 0.3}


@dataclass(frozen=True)
class Rule:
    """Patterns are (subject, predicate, object); a term that begins with ``?`` is a variable.

    A predicate variable stands for the predicates of a class (``classes``); ``guards`` lists
    the types that the value of a variable may have.
    """

    name: str
    body: tuple[tuple[str, str, str], ...]
    head: tuple[str, str, str]
    unless: tuple[tuple[str, str, str], ...] = ()
    confidence: str | float = "min"
    classes: dict[str, str] = field(default_factory=dict)
    guards: dict[str, tuple[str, ...]] = field(default_factory=dict)


# Predicates that a rule may name by their class.
CLASSES = {"capability": ("develops", "produces", "manufactures", "operates", "publishes"), "activity": ("uses", "provides", "enables", "works_by")}



def parse_rule(data: dict) -> Rule:
    """A rule from its JSON object; missing fields have the defaults of the format."""
    own = lambda p: (str(p.get("subject") or ""), str(p.get("predicate") or ""), str(p.get("object") or ""))
    patterns = [*data.get("if_pattern", []), *data.get("unless_pattern", [])]
    classes = {str(p["predicate"]): p["predicate_class"] for p in patterns if p.get("predicate_class")}
    how = {"min_stability": "min", "max_stability": "max"}.get(data.get("confidence_rule") or "min_stability", float(data.get("constant_confidence", 0.5)))
    guards = {variable: tuple(types) for variable, types in (data.get("type_guards") or {}).items()}
    return Rule(str(data.get("rule_id") or ""), tuple(map(own, data.get("if_pattern", []))), own(data["then_pattern"]), tuple(map(own, data.get("unless_pattern", []))), how, classes, guards)


def parse_rules(items: Iterable[dict]) -> tuple[Rule, ...]:
    """The enabled rules of a list of JSON objects."""
    return tuple(parse_rule(item) for item in items if item.get("enabled", True))


def load_rules(path: str | Path) -> tuple[Rule, ...]:
    """The enabled rules of a JSON file; a rule added there needs no code."""
    return parse_rules(json.loads(Path(path).read_text(encoding="utf-8")))


BASE_RULES = load_rules(Path(__file__).resolve().parent.parent / "data" / "base_rules.json")


def _rows(facts: DataFrame, pattern: tuple[str, str, str], n: int, classes: dict[str, str]) -> DataFrame:
    s, p, o = pattern
    rows = facts.where(F.col("predicate").isin(*CLASSES[classes[p]]) if p in classes else F.col("predicate") == p)
    for term, name in ((s, "subject"), (o, "object")):
        if not term.startswith("?"):
            rows = rows.where(rule_key(F.col(name)) == rule_key(F.lit(term)))
    names = {t: c for t, c in ((s, "subject"), (p, "predicate"), (o, "object")) if t.startswith("?")}
    score = reduce(lambda w, kv: w.when(F.col("stability") == kv[0], kv[1]), STABILITY.items(), F.when(F.lit(False), 0.0)).otherwise(0.5)
    rows = rows.where(rule_key(F.col("subject")) == rule_key(F.col("object"))) if s == o and s.startswith("?") else rows
    keys = [(F.col(c) if c == "predicate" else rule_key(F.col(c))).alias(_key(t)) for t, c in names.items()]
    return rows.select(*(F.col(c).alias(t) for t, c in names.items()), *keys, score.alias(f"_score{n}"))


def _key(variable: str) -> str:
    """Name of the column by which a variable's values are compared."""
    return f"~{variable}"


def infer(facts: DataFrame, rule: Rule, types: DataFrame | None = None) -> DataFrame:
    """Distinct (subject, predicate, object, rule, confidence) that a rule gives; reflexive ones go.

    ``types`` is (entity, type), for the guards; an entity without a type passes none.
    """
    parts = [_rows(facts, pattern, n, rule.classes) for n, pattern in enumerate(rule.body)]
    for variable, allowed in rule.guards.items():
        if types is None:
            raise ValueError(f"{rule.name} needs the types of entities")
        good = types.where(F.col("type").isin(*allowed)).select(rule_key(F.col("entity")).alias("_e")).distinct()
        parts = [p.join(good, F.col(f"`{_key(variable)}`") == F.col("_e"), "left_semi") if variable in p.columns else p for p in parts]

    def joined_with(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c.startswith("~") and c in a.columns]
        return a.join(b.drop(*(c[1:] for c in shared)), shared)

    def spared(joined: DataFrame) -> DataFrame:
        for n, pattern in enumerate(rule.unless):
            other = _rows(facts, pattern, 100 + n, rule.classes)
            shared = [c for c in other.columns if c.startswith("~") and c in joined.columns]
            joined = joined.join(other.select(*(F.col(f"`{c}`") for c in shared)).distinct(), shared, "left_anti")
        return joined

    scores = [F.col(f"_score{n}") for n in range(len(rule.body))]
    if isinstance(rule.confidence, float):
        score = F.lit(rule.confidence)
    else:
        score = scores[0] if len(scores) == 1 else {"min": F.least, "max": F.greatest}[rule.confidence](*scores)
    term = lambda t: F.col(f"`{t}`") if t.startswith("?") else F.lit(t)

    def headed(joined: DataFrame) -> DataFrame:
        out = joined.select(term(rule.head[0]).alias("subject"), term(rule.head[1]).alias("predicate"), term(rule.head[2]).alias("object"), score.alias("confidence"))
        return out.where(rule_key(F.col("subject")) != rule_key(F.col("object")))

    best = lambda rows: rows.groupBy("subject", "predicate", "object").agg(F.max("confidence").alias("confidence"))
    if _is_chain(rule):
        a, b = (_best(part, n, rule) for n, part in enumerate(parts))
        # who has one way gives each triple once, so only those with more ways are grouped by triple
        alone, several = a.where("_ways = 1").drop("_ways"), a.where("_ways > 1").drop("_ways")
        out = headed(spared(joined_with(alone, b))).unionByName(best(headed(spared(joined_with(several, b)))))
    else:
        out = best(headed(spared(reduce(joined_with, parts))))
    return out.withColumn("rule", F.lit(rule.name))


def _is_chain(rule: Rule) -> bool:
    """Whether a rule leads from ?A to ?B by a named predicate, and on by a class of predicates, where one fact meets many, to what its head says of ?A."""
    if len(rule.body) != 2:
        return False
    (a, p, b), (c, q, d) = rule.body
    return all(t.startswith("?") for t in (a, b, d)) and len({a, b, q, d}) == 4 and b == c and not p.startswith("?") and q in rule.classes and rule.head == (a, q, d)


def _best(part: DataFrame, n: int, rule: Rule) -> DataFrame:
    """The first or second pattern of a chain: distinct rows without the name of ?B, each with its best score; the first with ``_ways``, the number of keys of ?B that a subject has."""
    start, middle = rule.body[0][0], rule.body[0][2]
    keys = [f"`{c}`" for c in part.columns if c != middle and not c.startswith("_")]
    rows = part.select(*keys, f"_score{n}")
    if n:
        return rows.groupBy(*keys).agg(F.max(f"_score{n}").alias(f"_score{n}"))
    # one exchange serves the grouping and the count
    rows = rows.repartition(F.col(f"`{start}`")).groupBy(*keys).agg(F.max(f"_score{n}").alias(f"_score{n}"))
    return rows.withColumn("_ways", F.count("*").over(Window.partitionBy(F.col(f"`{start}`"))))


def infer_all(facts: DataFrame, rules: tuple[Rule, ...] = BASE_RULES, types: DataFrame | None = None) -> DataFrame:
    """The inferences of several rules, each over the stored facts alone."""
    return reduce(DataFrame.unionByName, [infer(facts, rule, types) for rule in rules])


def cooccurrences(facts: DataFrame, classes: DataFrame, min_support: int = 2, min_confidence: float = 0.5) -> DataFrame:
    """(predicate, class, implied, support, population, confidence): who has the first predicate with an object of the class has the other one.

    ``classes`` has distinct (object, class). Support and population count subjects.
    """
    own = facts.select("subject", F.col("predicate").alias("implied")).distinct()
    members = facts.select("subject", "predicate", "object").distinct().join(classes, "object").select("predicate", "class", "subject").distinct()
    size = members.groupBy("predicate", "class").agg(F.count("*").alias("population"))
    both = members.join(own, "subject").where("implied != predicate").groupBy("predicate", "class", "implied").agg(F.count("*").alias("support"))
    out = both.where(F.col("support") >= min_support).join(size, ["predicate", "class"]).withColumn("confidence", F.round(F.col("support") / F.col("population"), 6))
    return out.where(F.col("confidence") >= min_confidence).select("predicate", "class", "implied", "support", "population", "confidence")


def class_implications(members: DataFrame, facts: DataFrame, min_support: int = 2, min_confidence: float = 0.5) -> DataFrame:
    """(class, predicate, object, support, population, confidence): what members of a class share.

    ``members`` has distinct (subject, class); support counts members, not facts.
    """
    size = members.groupBy("class").agg(F.count("*").alias("population"))
    shared = members.join(facts.select("subject", "predicate", "object").distinct(), "subject").groupBy("class", "predicate", "object").agg(F.count("*").alias("support"))
    out = shared.where(F.col("support") >= min_support).join(size, "class").withColumn("confidence", F.round(F.col("support") / F.col("population"), 6))
    return out.where(F.col("confidence") >= min_confidence)


def lost_without(facts: DataFrame, rule: Rule, removed: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Inferences of a rule that go when the facts in ``removed`` (subject, predicate, object) are taken out."""
    keys = ["subject", "predicate", "object"]
    left = facts.join(removed.select(*keys), keys, "left_anti")
    return infer(facts, rule, types).join(infer(left, rule, types).select(*keys), keys, "left_anti")


# Predicates that have an inverse twin, and the phrases of a definition that name a maker or an owner.
INVERSES = {"founded": "founded_by", "leader_of": "led_by"}
MAKER = r"(?i)\b(?:developed|operated|made|created|produced|built)\s+by\s+([A-Z][A-Za-z0-9 ]*)"
OWNER = r"(?i)\b(?:division|subsidiary|unit)\s+of\s+([A-Z][A-Za-z0-9 ]*)"


def normalized(relations: DataFrame, definitions: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, predicate, object, stability): relations, their inverse twins, classes of definitions, and owners that definitions name.

    ``relations`` is (subject, predicate, object, stability), ``definitions`` (subject, definition, stability),
    ``labels`` (label); an owner counts if it is a label, and not the subject itself.
    """
    own = relations.where("subject != '' AND predicate != '' AND object != ''").select("subject", "predicate", "object", "stability")
    twin = reduce(lambda w, kv: w.when(F.col("predicate") == kv[0], kv[1]), INVERSES.items(), F.when(F.lit(False), ""))
    turned = own.select(F.col("object").alias("subject"), twin.alias("predicate"), F.col("subject").alias("object"), "stability").where("predicate IS NOT NULL")
    told = definitions.where("subject != '' AND definition != ''")
    classes = told.select("subject", F.lit("is_a").alias("predicate"), F.col("definition").alias("object"), "stability")
    owner = F.regexp_extract("definition", OWNER, 1)
    named = told.select("subject", "stability", F.trim(F.when(owner != "", owner).otherwise(F.regexp_extract("definition", MAKER, 1))).alias("_owner"), (owner != "").alias("_part"))
    known = labels.select("label").distinct()
    named = named.join(known, rule_key(F.col("_owner")) == rule_key(F.col("label"))).where(rule_key(F.col("label")) != rule_key(F.col("subject")))
    predicates = F.when(F.col("_part"), F.array(F.lit("owned_by"), F.lit("subsidiary_of"))).otherwise(F.array(F.lit("owned_by")))
    owned = named.select("subject", F.explode(predicates).alias("predicate"), F.col("label").alias("object"), "stability")
    return own.unionByName(turned).unionByName(classes).unionByName(owned)


def shared_object_class(facts: DataFrame, classes: DataFrame) -> DataFrame:
    """(subject, predicate, class): the first class, in order, that every object of a subject's predicate belongs to; null if there is none.

    ``facts`` and ``classes`` (object, class) are distinct.
    """
    size = facts.groupBy("subject", "predicate").agg(F.count("*").alias("_n"))
    held = facts.join(classes, "object").groupBy("subject", "predicate", "class").agg(F.count("*").alias("_k"))
    common = held.join(size, ["subject", "predicate"]).where("_k = _n").groupBy("subject", "predicate").agg(F.min("class").alias("class"))
    return size.select("subject", "predicate").join(common, ["subject", "predicate"], "left")


def ranked_patterns(patterns: DataFrame, id: str, top: int = 200) -> DataFrame:
    """The best patterns, surest first, then with most support, then by id, with their rank."""
    best = patterns.orderBy(F.desc("confidence"), F.desc("support"), id).limit(top)
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col(id).alias("i"))
    # no more than ``top`` rows are numbered
    return best.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*best.columns).alias("r")))).alias("a")).select(F.posexplode("a").alias("rank", "x")).select((F.col("rank") + 1).alias("rank"), "x.r.*")


def relevant_patterns(patterns: DataFrame, members: DataFrame, entities: DataFrame, top: int = 3) -> DataFrame:
    """(entity, rank, pattern_id): the best ranked patterns whose members (pattern_id, entity) hold each entity."""
    hits = entities.select("entity").distinct().join(members.select("pattern_id", "entity").distinct(), "entity").join(patterns.select("pattern_id", F.col("rank").alias("_r")), "pattern_id")
    best = Window.partitionBy("entity").orderBy("_r", "pattern_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("entity", "rank", "pattern_id")
