"""Claims of wiki pages: definitions, relations, links and facts that need their source, all from one pass over a page's markup.

A page is (page, title, text, retrieved_at); its text is markup with ``{{Infobox …}}``, ``[[target|surface]]`` and ``'''bold'''``. Each page
gives tagged rows of one shape, which are written once and then taken apart by kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.lineage import cut

# How sentences say what a page's subject is, leads, is known for and makes.
COPULA = r"(?i)\b(?:is|are|was|were)\s+(?:a|an|the)\s+(.+)"
DEFINITION = r"(?i)^(.*?)(?: known for| known as| based in| founded |, |$)"
LEADERSHIP = r"(?i)((?:known for\s+(?:his|her|its|their)\s+)?leadership of\s+(.+?))(?:\.|$)"
KNOWN_FOR = r"(?i)known for\s+(?:his|her|its|their)?\s*(.+?)(?:\.|$)"
VERBS = (("manufactures", "produces"), ("produces", "produces"), ("develops", "develops"), ("publishes", "publishes"))
OBJECTS = r"(?i)\s+and\s+|,\s*|;\s*"
# Measurements that hold for a time only, from a source.
AMOUNT = r"(?i)(US\$\s?[\d.,]+\s*(?:trillion|billion|million)?)"
NET_WORTH, WEALTHIEST, RANKED = r"(?i)net[\s-]?worth", r"(?i)\b(wealthiest|richest)\b", r"(?i)\branked\s+(?:number\s*)?(\d+)\b"
VOLATILE = (
    r"(?i)\b(?:wealthiest|richest)\s+(?:person|people|man|woman|individual)\b",
    r"(?i)\brank(?:ed|ing)?\s+(?:number\s*|no\.?\s*|#)?\d+",
    r"(?i)\bcurrent\s+(?:ceo|chief executive|president|prime minister|office holder)\b.*\b(?:is|are|was)\b",
    r"(?i)market cap(?:italization)?\b.*(?:US\$|\d)",
    r"(?i)\b(?:current|stock|share)\s+price\b.*(?:US\$|\d)",
    r"(?i)\bpopulation\b.*\b(?:is|of)\b.*\d",
)
NO_AMOUNT = "net worth estimate (amount not specified)"
SOURCES = ("Forbes", "Bloomberg", "Fortune")
OFFICES = ("ceo", "chief executive", "president", "office")
# Relations of the infobox, by key; founders are the subjects of theirs.
BOX = (("known_for", "known_for"), ("products", "produces"), ("produces", "produces"))
FOUNDERS = ("founder", "founders", "founded_by")
SNAPSHOTS = ("leader_of",)
KINDS = ("definition", "relation", "context_link", "source_fact")
_ROW = "array<struct<kind:string,subject:string,predicate:string,object:string,evidence:string,source_name:string,claim_type:string,stability:string,risk:string,temporal_class:string,as_of:string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Adds lead (plain text of the first paragraph), box (keys and values), links (surfaces and targets) and as_of (month)."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")
    box = F.regexp_extract(text, r"(?is)\{\{Infobox([^{}]*)\}\}", 1)
    field = r"(?m)^\s*\|\s*([^=|\n]+?)\s*=[ \t]*([^\n]*?)\s*$"
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(box, F.lit(field), F.lit(1)), F.lower).alias("k"), F.regexp_extract_all(box, F.lit(field), F.lit(2)).alias("v"))
    link = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
    target, surface = (F.regexp_extract_all(text, F.lit(link), F.lit(g)) for g in (1, 2))
    links = F.zip_with(target, surface, lambda t, s: F.struct(F.trim(F.when(s != "", s).otherwise(t)).alias("surface"), F.trim(t).alias("target")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)\{\{[^{}]*\}\}", ""), r"(?s)<ref[^>]*/>|<ref[^>]*>.*?</ref>", ""))
    lead = F.regexp_replace(F.regexp_replace(F.try_element_at(F.split(bare, r"\n\s*\n"), F.lit(1)), r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"), "'{2,}", "")
    month = F.regexp_extract("retrieved_at", r"^(\d{4}-\d{2})", 1)
    return pages.withColumns({"lead": F.trim(F.regexp_replace(lead, r"\s+", " ")), "box": pairs, "links": links, "as_of": F.when(month != "", month).otherwise(F.coalesce("retrieved_at", F.lit("")))})


def volatile(sentence: Column) -> Column:
    """Whether a sentence gives a measurement of the present."""
    worth = sentence.rlike(NET_WORTH) & (sentence.rlike(AMOUNT) | sentence.rlike(r"(?i)\bestimat"))
    return reduce(lambda a, p: a | sentence.rlike(p), VOLATILE, worth)


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"\.+$", ""))


def split_objects(raw: Column) -> Column:
    """The things that a list names, without articles."""
    parts = F.transform(F.split(raw, OBJECTS), lambda p: F.regexp_replace(_tidy(p), r"(?i)^(?:the|a|an)\s+", ""))
    return F.filter(parts, lambda p: p != "")


def _row(kind: str, subject: Column, predicate: Column, object_: Column, evidence: Column, source: Column | None = None, claim: Column | None = None, stability: str = "semi_stable", risk: str = "medium", temporal: Column | None = None, as_of: Column | None = None) -> Column:
    empty = F.lit("")
    values = (F.lit(kind), subject, predicate, object_, evidence, empty if source is None else source, empty if claim is None else claim, F.lit(stability), F.lit(risk), F.lit("historical") if temporal is None else temporal, empty if as_of is None else as_of)
    return F.struct(*(v.alias(n) for v, n in zip(values, ("kind", "subject", "predicate", "object", "evidence", "source_name", "claim_type", "stability", "risk", "temporal_class", "as_of"), strict=True)))


def _relations(predicate: str, objects: Column, evidence: Column) -> Column:
    """Rows of one relation of the page to several things; a relation that changes has its month."""
    snapshot = predicate in SNAPSHOTS
    return F.transform(split_objects(objects), lambda o: _row("relation", F.col("title"), F.lit(predicate), o, evidence, temporal=F.lit("snapshot" if snapshot else "historical"), as_of=F.col("as_of") if snapshot else None))


def _of_sentence(s: Column) -> Column:
    """Relation rows of a sentence: leadership alone, or what it's known for and makes."""
    none = F.array().cast(_ROW)
    part = lambda p, g: F.regexp_extract(s, p, g)
    known = F.when(s.rlike(KNOWN_FOR), _relations("known_for", part(KNOWN_FOR, 1), F.trim(part(KNOWN_FOR, 0)))).otherwise(none)
    made = []
    for verb, predicate in VERBS:
        pattern = rf"(?i)\b{verb}\b\s+(.+?)(?:\.|$)"
        made.append(F.when(s.rlike(pattern), _relations(predicate, part(pattern, 1), F.trim(part(pattern, 0)))).otherwise(none))
    return F.when(volatile(s), none).when(s.rlike(LEADERSHIP), _relations("leader_of", part(LEADERSHIP, 2), F.trim(part(LEADERSHIP, 1)))).otherwise(F.concat(known, *made))


def _source_fact(s: Column) -> Column:
    """The fact of a sentence that gives a measurement of the present."""
    low, amount = F.lower(s), F.trim(F.regexp_extract(s, AMOUNT, 1))
    has = lambda word: F.contains(low, F.lit(word))
    office = has("current") & reduce(lambda a, o: a | has(o), OFFICES, F.lit(False))
    cases = [
        (s.rlike(NET_WORTH) & (has("estimat") | (amount != "")), "estimated_net_worth", F.when(amount != "", amount).otherwise(NO_AMOUNT), "time_sensitive_estimate"),
        (s.rlike(WEALTHIEST), "wealth_rank", s, "time_sensitive_ranking"),
        (s.rlike(RANKED), "ranking", F.concat(F.lit("rank "), F.regexp_extract(s, RANKED, 1)), "time_sensitive_ranking"),
        (office, "current_office_holder", s, "time_sensitive_office"),
        (has("market cap"), "market_capitalization", s, "time_sensitive_estimate"),
        (has("price"), "current_price", s, "time_sensitive_estimate"),
        (has("population"), "current_population", s, "time_sensitive_estimate"),
        (F.lit(True), "current_estimate", s, "time_sensitive_estimate"),
    ]
    which = lambda k: reduce(lambda w, c: w.when(c[0], c[k] if isinstance(c[k], Column) else F.lit(c[k])), cases, F)
    source = reduce(lambda w, x: w.when(has(x.lower()), F.lit(x)), SOURCES, F).otherwise("unknown_source")
    return _row("source_fact", F.col("title"), which(1), which(2), s, source, which(3), "volatile", "high", F.lit("snapshot"), F.col("as_of"))


def claims(pages: DataFrame) -> DataFrame:
    """(page, place, kind, subject, predicate, object, evidence, source_name, claim_type, stability, risk, temporal_class, as_of): all claims of each page, in order."""
    rows = parsed(pages)
    sentences = F.filter(F.transform(F.split("lead", r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")
    # sentences are a column of their own, so each part below is taken from them once
    rows = rows.withColumn("sentences", sentences)
    none, title = F.array().cast(_ROW), F.col("title")
    first = F.coalesce(F.get("sentences", F.lit(0)), F.lit(""))
    object_ = _tidy(F.regexp_extract(F.trim(F.regexp_extract(first, COPULA, 1)), DEFINITION, 1))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    definition = F.when((object_ != "") & (plain(title) != plain(object_)), F.array(_row("definition", title, F.lit("is_a"), object_, first, stability="stable", risk="low"))).otherwise(none)
    relations = F.flatten(F.transform("sentences", _of_sentence))
    value = lambda key: F.try_element_at(F.filter("box", lambda x: x["k"] == key), F.lit(-1))["v"]
    box = [F.when(value(k).isNotNull(), _relations(p, value(k), F.concat(F.lit(f"{k}: "), value(k)))).otherwise(none) for k, p in BOX]
    founders = [F.when(value(k).isNotNull(), F.transform(split_objects(value(k)), lambda o: _row("relation", o, F.lit("founded"), title, F.concat(o, F.lit(" founded "), title)))).otherwise(none) for k in FOUNDERS]
    links = F.transform("links", lambda x: _row("context_link", title, F.lit("mentioned_with"), x["target"], x["surface"], stability="", risk="", temporal=F.lit("")))
    facts = F.transform(F.filter("sentences", volatile), _source_fact)
    return rows.select("page", F.posexplode(F.concat(definition, relations, *box, *founders, links, facts)).alias("place", "c")).select("page", F.col("place").cast("long").alias("place"), "c.*")


def by_kind(found: DataFrame) -> dict[str, DataFrame]:
    """The claims of each kind; the tagged rows are computed and written once."""
    rows = cut(found)
    return {kind: rows.where(F.col("kind") == kind) for kind in KINDS}


# Fixed values of sentence patterns: templates without content, and frames that are known.
GENERIC_TEMPLATES = (
    "{subject} did something", "{subject} was there", "{subject} moved", "{subject} was important", "{subject} continued", "{subject} had something", "{subject} used something", "{subject} was notable",
    "{subject} occurred",
)
FRAMES = (
    "financial_transaction", "natural_geography", "animal_behavior", "sports_equipment_use", "bird_behavior", "heavy_machinery_operation", "music_performance", "natural_material", "seasonal_transition",
    "mechanical_device", "document_closure",
)


def judged_patterns(candidates: DataFrame) -> DataFrame:
    """Sentence patterns (source_id, term, sense, pattern_type, frame, template) once each, with id, slots, decision and reason."""
    slots = F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), F.lit(1))
    raw = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("source_id", "term", "sense", "pattern_type", "template")))
    generic = F.lower(F.trim("template")).isin(*GENERIC_TEMPLATES)
    bare = F.size(F.array_remove(slots, "subject")) == 0
    known = F.col("frame").isin(*FRAMES)
    rows = candidates.withColumns({
        "pattern_id": F.concat(F.lit("pat-"), F.substring(F.sha2(raw, 256), 1, 12)),
        "slots": F.array_join(slots, ","),
        "decision": F.when(generic | bare, "rejected_auto").when(~known, "needs_review").otherwise("accepted_auto"),
        "reason": F.when(generic, "generic_template").when(bare, "no_concrete_slots").when(~known, F.concat(F.lit("unknown_semantic_frame:"), "frame")).otherwise("concrete_slots_known_frame"),
    })
    return rows.dropDuplicates(["pattern_id"])
