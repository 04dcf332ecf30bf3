"""Scalar functions on words, names, links, dates and labels, as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.normalize import rule_key

# Ranks of temporal classes, kinds of entities by words of a definition in order, and windows of freshness.
TEMPORAL_RANK = {"historical": 0, "snapshot": 1, "aggregate": 2, "derived": 3}
TYPE_RULES = (
    ("person", r"(?i)\b(person|scientist|engineer|entrepreneur|author|founder|actor|singer|politician|businessman)\b"),
    ("organization", r"(?i)\b(company|corporation|organization|agency|university|manufacturer|firm|seller)\b"),
    ("place", r"(?i)\b(city|country|state|region|town|river|island|nation)\b"),
    ("product", r"(?i)\b(product|device|vehicle|software|rocket|car|phone|widget|item)\b"),
    ("event", r"(?i)\b(event|war|conference|election|festival|order)\b"),
)
VOWELS = "aeiouy"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(rule_key(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clip(text: Column, size: int) -> Column:
    """At most ``size`` characters, cut after a word, with dots where something is left out."""
    cut = F.regexp_replace(F.substring(text, 1, size - 3), r"\s+\S*$", "")
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("...")))


def listed(items: Column) -> Column:
    """``a``, ``a and b``, or ``a, b, and c``."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    last = F.element_at(items, -1)
    return F.when(n == 0, "").when(n == 1, head).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


def base_verb(verb: Column) -> Column:
    """Third person to base form."""
    es = verb.rlike("(shes|ches|xes|sses)$")
    return F.when(es, F.regexp_replace(verb, "es$", "")).when(verb.rlike("s$") & ~verb.rlike("ss$"), F.regexp_replace(verb, "s$", "")).otherwise(verb)


def singular(word: Column) -> Column:
    """Plural folding: a longer word loses its last ``s``."""
    low = rule_key(word)
    return F.when((F.length(low) > 3) & F.endswith(low, F.lit("s")), F.substring(low, F.lit(1), F.length(low) - 1)).otherwise(low)


def syllables(text: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(text), f"[^{VOWELS}]", "")).cast("long")


def rhyme_key(word: Column) -> Column:
    """The end of a word from its last vowel but one; from its only vowel; else the word."""
    low = F.lower(word)
    two = F.regexp_extract(low, f"([{VOWELS}][^{VOWELS}]*[{VOWELS}][^{VOWELS}]*)$", 1)
    one = F.regexp_extract(low, f"([{VOWELS}][^{VOWELS}]*)$", 1)
    return F.when(two != "", two).when(one != "", one).otherwise(low)


def permalink(url: Column) -> Column:
    """Host and path in lower case without www, query, fragment and a slash at the end."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(?:www\.)?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), "/+$", "")


def domain_user(raw: Column) -> Column:
    """Struct of user and domain of ``DOMAIN\\user``; without a backslash all is the user; blanks are null."""
    at = F.instr(raw, "\\")
    blank = lambda c: F.when(c != "", c)
    user = F.when(at > 0, blank(F.substring(raw, at + 1, F.length(raw)))).otherwise(raw)
    return F.struct(user.alias("user"), F.when(at > 1, F.substring(raw, F.lit(1), at - 1)).alias("domain"))


def entity_type(definition: Column) -> Column:
    """The first kind, in order, whose words a definition holds; else ``other``."""
    return reduce(lambda w, r: w.when(definition.rlike(r[1]), r[0]), TYPE_RULES, F.when(F.coalesce(definition, F.lit("")) == "", "other")).otherwise("other")


def confidence_word(value: Column) -> Column:
    return F.when(value >= 0.85, "high").when(value >= 0.6, "medium").otherwise("low")


def temporal_class(predicate: Column, stability: Column, snapshots: tuple[str, ...], aggregates: tuple[str, ...], historical: tuple[str, ...]) -> Column:
    """Temporal class of a relation; null where it must be reviewed."""
    return F.when(predicate.isin(*snapshots), "snapshot").when(predicate.isin(*aggregates), "aggregate").when(predicate.isin(*historical), "historical").when(stability == "volatile", "snapshot")


def weakest(classes: Column) -> Column:
    """The weakest temporal class of an array; ``historical`` for an empty one."""
    rank = lambda c: reduce(lambda w, kv: w.when(c == kv[0], kv[1]), TEMPORAL_RANK.items(), F.when(F.lit(False), 0)).otherwise(-1)
    ranked = F.transform(classes, lambda c: F.struct(rank(c).alias("r"), c.alias("c")))
    return F.coalesce(F.array_max(ranked)["c"], F.lit("historical"))


def as_of_date(text: Column) -> Column:
    """A date from ``YYYY-MM-DD`` or ``YYYY-MM`` (its first day); null for others."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}$"), F.try_to_date(F.concat(text, F.lit("-01")))).when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text))


def wiki_links(text: Column) -> Column:
    """Targets of [[target]] and [[target|label]] links, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.trim(x)))


def intents(text: Column, keywords: dict[str, str]) -> Column:
    """Sorted relations that a text names by keywords; a keyword within a longer one that was found doesn't count.

    Keywords are taken longest first, each found one is blanked out, so a shorter one meets only what is left. Patterns are made only
    of those whose letters stand in the text; blanks make no new ones. A keyword that isn't plain words is a pattern and always tried.
    """
    ordered = sorted(keywords.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    table = F.array(*(F.struct(F.lit(rf"(?<![a-z0-9_]){k}(?![a-z0-9_])").alias("p"), F.lit(v).alias("v"), F.lit(k if re.fullmatch("[a-z0-9_ ]+", k) else "").alias("stem")) for k, v in ordered))

    def step(state: Column, row: Column) -> Column:
        hit = F.regexp_like(state["left"], row["p"])
        return F.struct(F.when(hit, F.regexp_replace(state["left"], row["p"], F.lit("#"))).otherwise(state["left"]).alias("left"), F.when(hit, F.array_append(state["found"], row["v"])).otherwise(state["found"]).alias("found"))

    def named(key: Column) -> Column:
        start = F.struct(key.alias("left"), F.array().cast("array<string>").alias("found"))
        return F.aggregate(F.filter(table, lambda r: key.contains(r["stem"])), start, step, lambda s: F.array_sort(F.array_distinct(s["found"])))

    # a variable of a transform is computed once, however often it is used
    found = F.transform(F.transform(F.array(rule_key(F.coalesce(text, F.lit("")))), named), lambda f: F.when(F.array_contains(f, "headquartered_in"), F.array_remove(f, "located_in")).otherwise(f))
    return F.get(found, F.lit(0))
