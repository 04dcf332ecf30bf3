"""Firewalls between extracted items and served facts: each gives a verdict and the first reason for it.

Items are (item_id, kind, subject, predicate, object, evidence, source_page); of a definition
``object`` is the definition. Each gate is one column expression; only the check for aliases
of one object looks at other items, by a join on their counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.lineage import cut

# Words of names, beginnings and verbs of pieces of sentences, and things too general to be named.
FUNCTION_WORDS = "of the a an and for in to on at by de von van del della".split()
FRAGMENT_LEADS = "if many some therefore however although because while such what most several various".split()
CLAUSE_VERBS = (
    "is are was were be been being has have had owns own owned uses use used operates operate operated makes make made intended includes include included provides provide develops develop "
    "developed produces produce produced said says announced acquired acquires brought consists enables enable"
).split()
FRAGMENT_MARKERS = "also usually therefore previously".split()
GENERIC_SUBJECTS = (
    "economy of the united states", "satellite internet", "internet service provider", "stock exchange", "business journalism", "initial public offering", "subsidiary", "founder", "technology",
    "company", "corporation", "vehicle", "electric vehicle", "product", "business", "organization", "model", "satellite constellation", "the following exchanges", "private spaceflight",
)
GENERIC_OBJECTS = ("aggressive", "control", "british", "american", "rocket", "rockets", "fuselage", "novels", "singer", "clergyman", "economic news", "social media", "private spaceflight")
OBJECT_LEADS = "which but and as other that including or who where although began especially multiple his her".split()
OBJECT_CLAUSES = ("as well as", " which ", " but ", "that can", "that meant", "including", " who ", " where ", "such as")
BROAD_CLASSES = ("artificial intelligence", "machine learning", "computer science", "information technology", "deep learning", "electric vehicle", "renewable energy", "social media", "e-commerce", "cloud computing")
NATIONALITIES = "american chinese european british german japanese korean indian canadian australian french italian spanish russian israeli".split()
NEGATIONS = ("never developed", "not developed", "considered but never", "planned but not", "never built", "never produced", "not produced")
OWNERSHIP = ("owned by", "operated by", "acquired by", "wholly owned subsidiary", "part of", "subsidiary of", "purchased by")
BAD_DEFINITIONS = (
    "good thing", "best ", "greatest", "largest", "biggest", "proposal to", "rename", "award", "winner", "son of", "daughter of", "father of", "mother of", "brother of", "sister of", "wife of",
    "husband of", "physical place where", "co-inventor", " who ",
)
BAD_LEADS = "also previously additionally further later".split()
GEMS = "ruby sapphire emerald diamond pearl opal topaz garnet amethyst aquamarine peridot citrine turquoise tanzanite alexandrite moonstone spinel zircon onyx".split()
MONTHS = "january february march april may june july august september october november december".split()
# Which check judges which predicate; others get the general one.
EVENTS = ("ceased_operations", "construction_started", "filed_for_bankruptcy", "first_released", "introduced")
CONCEPTS = ("has_facility", "uses", "provides", "enables", "used_for", "works_by")
# Fixed values of the second gate: places, artifacts, volatile offices, beginnings, general things, cut definitions.
PLACES = (
    "united states", "us", "usa", "u.s.", "u.s.a.", "uk", "united kingdom", "eu", "european union", "china", "russia", "germany", "france", "japan", "india", "canada", "australia", "brazil", "washington",
    "huntington beach", "auburn hills", "opelika", "london", "new york", "san jose", "seattle", "palo alto", "mountain view", "menlo park", "redwood city", "chicago", "houston", "detroit", "california",
    "texas", "nevada", "stock exchange", "the stock exchange", "government", "the government", "congress", "senate", "parliament",
)
CORPORATE = ("headquartered_in", "owned_by", "subsidiary_of", "developed_by", "develops", "founded_by", "acquired_by", "operated_by", "manufactured_by")
STATES = ("us", "usa", "u.s.", "u.s.a.", "uk", "united kingdom", "eu", "china", "russia", "germany", "france", "japan", "india", "canada", "australia", "brazil", "washington")
TOWNS = ("huntington beach", "auburn hills", "opelika", "london", "washington", "new york", "seattle", "chicago", "houston", "detroit", "cape canaveral", "palo alto", "mountain view", "menlo park", "redwood city")
ARTIFACTS = r"(?i)\b(?:insignia|livery|logo|mission\s+patch|badge|emblem|seal|crest|coat\s+of\s+arms|flag|icon|symbol)\b"
VOLATILE = ("leader_of", "leads", "chairs", "heads", "current_ceo", "current_president", "current_chairman")
APPOSITION = r"(?i),\s+(?:officially|also\s+known\s+as|known\s+as|colloquially|formerly|sometimes\s+stylized|stylized|also\s+called|shortened\s+to|abbreviated\s+to)"
SUBJECT_LEADS = ("founding ", "the founding of ", "history of ", "overview of ", "background of ")
CUT_NAME = r"^[A-Z][a-z]+ [A-Z][a-z]{0,2}\.?\s*$"
GENERIC_ENTITIES = ("stock exchange", "the stock exchange", "government", "congress", "senate", "parliament", "the internet", "internet")
UNIVERSAL = r"(?i)^\s*(?:all|every|each|most|many|several|various)\s+"
PUBLISHER_PHRASE = r"(?i)(?:the\s+(?:society|association|institute|foundation)\s*$|\b(?:society|association)\s*$)"
LONG_TAIL = r"^(?:[A-Z][A-Za-z0-9/\-'.&]*)(?:\s+[A-Za-z0-9/\-'.&]+){4,}$"
CUT_ENDINGS = (" the u", " the u.", " to", ", to", " of", " in", "primary purpose is to establish", "primary purpose is to", " concerned", " associated", "primarily", " in consumer", " in the u")
SHORT_ENDS = "to of in at by for and or".split()
NATIONALITY_NOUN = r"^(?:american|british|french|german|chinese|canadian|australian|japanese|korean|indian|spanish|italian|russian|scottish|english|austrian|serbian|irish|israeli)\s+(\w{1,20})\s*$"
ROLES = (
    "academic activist architect artist author billionaire businessman businesswoman designer diplomat economist engineer entrepreneur executive filmmaker founder inventor investor journalist lawyer magnate "
    "philanthropist pilot politician professor scientist"
).split()
# Fixed values of the third gate: vehicles, aliases of one object, and participles that end a cut definition.
VEHICLES = "dragon orion capsule shuttle module lander probe rover station".split()
ALIASES = {"hp": "hewlett-packard", "hpq": "hewlett-packard"}
PARTICIPLES = "designed marketed offered developed concerned associated operated manufactured intended used produced created built".split()
INSTITUTIONS = (" university", " institute", " foundation", " corporation", " company", " inc", " group")
# Fixed values of the gate of sources: a lead definition, and terms that make one evaluative or dated.
LEAD = r"(?i)^(.{2,80}?)\s+(?:is|are|was|were)\s+(?:an?|the)\s+"
EVALUATIVE = "best better current currently important latest largest new novel recent significant state-of-the-art today".split()


#: Verdict and reason are one string, with a colon between them.
ACCEPT = "accept:"


def key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def _bare(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^a-z0-9]+|[^a-z0-9]+$", "")


def _any(column: Column, phrases) -> Column:
    return reduce(lambda a, p: a | F.contains(column, F.lit(p)), phrases, F.lit(False))


def _capital(words: Column) -> Column:
    small = lambda w: (_bare(w) != "") & ~_bare(w).isin(*FUNCTION_WORDS) & ~w.rlike("^[A-Z0-9]") & ~(w.rlike("[A-Z]") & (w == F.upper(w)))
    return ~F.exists(words, small)


def subject_ok(subject: Column) -> Column:
    """Whether a subject reads as a name, not as a piece of a sentence."""
    words = _words(subject)
    bad = lambda w: _bare(w).isin(*FRAGMENT_MARKERS, *CLAUSE_VERBS)
    return (F.size(words) > 0) & ~key(subject).isin(*GENERIC_SUBJECTS) & (F.size(words) <= 7) & ~F.coalesce(_bare(F.get(words, F.lit(0))).isin(*FRAGMENT_LEADS), F.lit(False)) & ~F.exists(words, bad) & _capital(words)


def entity_ok(name: Column) -> Column:
    """Whether an object reads as a name."""
    words = _words(name)
    led = F.coalesce(_bare(F.get(words, F.lit(0))).isin(*OBJECT_LEADS), F.lit(False))
    return (F.size(words) > 0) & ~key(name).isin(*GENERIC_OBJECTS) & (F.size(words) <= 6) & ~led & ~F.exists(words, lambda w: _bare(w).isin(*CLAUSE_VERBS)) & _capital(words)


def phrase_ok(name: Column) -> Column:
    """Whether an object is a clean phrase; common nouns may be."""
    words = _words(name)
    led = F.coalesce(_bare(F.get(words, F.lit(0))).isin(*OBJECT_LEADS), F.lit(False))
    clause = _any(F.concat(F.lit(" "), key(name), F.lit(" ")), OBJECT_CLAUSES)
    return (F.size(words) > 0) & ~key(name).isin(*GENERIC_OBJECTS) & ~name.rlike(r"[()]") & ~name.rlike("(?:19|20)[0-9]{2}") & (F.size(words) <= 6) & ~led & ~clause


def in_evidence(name: Column, evidence: Column) -> Column:
    return (key(name) != "") & F.contains(key(evidence), key(name))


def _verdict(verdict: str, reason: str) -> Column:
    return F.lit(f"{verdict}:{reason}")


def _first(*steps: tuple[Column, str, str]) -> Column:
    """The first step whose condition holds decides; else the item is accepted."""
    out = None
    for condition, verdict, reason in steps:
        out = F.when(condition, _verdict(verdict, reason)) if out is None else out.when(condition, _verdict(verdict, reason))
    return _verdict("accept", "") if out is None else out.otherwise(_verdict("accept", ""))


def prepared(items: DataFrame) -> DataFrame:
    """Items with what several checks ask: keys, words, shapes of subject and object; each is computed once. Null fields count as empty."""
    rows = items.fillna("", ["subject", "predicate", "object", "evidence", "source_page"])
    s, o, e = F.col("subject"), F.col("object"), F.col("evidence")
    named = F.exists(_words(o), lambda w: ~_bare(w).isin(*FUNCTION_WORDS) & w.rlike("^[A-Z]") & (w != F.upper(w)))
    own = {"_s": key(s), "_p": key(F.col("predicate")), "_o": key(o), "_told": key(e), "_sok": subject_ok(s), "_entity": entity_ok(o), "_phrase": phrase_ok(o), "_absent": ~in_evidence(o, e), "_named": named, "_n_words": F.size(_words(o))}
    return rows.withColumns(own)


def relation_verdict() -> Column:
    """First gate: a check for each predicate; for ``prepared`` items, as the others."""
    s, o, e = F.col("subject"), F.col("object"), F.col("evidence")
    p, told = F.col("_p"), F.col("_told")
    bad_s, entity, phrase, absent, named, words = ~F.col("_sok"), F.col("_entity"), F.col("_phrase"), F.col("_absent"), F.col("_named"), F.col("_n_words")
    checks = {
        ("known_for",): _known_for(bad_s, _any(told, ("known for", "best known", "famous for")) & entity & (words <= 3)),
        ("subsidiary_of",): _first((bad_s, "reject", "subsidiary_bad_subject"), (~entity, "reject", "subsidiary_bad_object"), (~in_evidence(s, e), "reject", "subsidiary_subject_not_in_evidence"), (absent, "reject", "subsidiary_object_not_in_evidence")),
        ("owned_by",): _first((bad_s, "reject", "owned_by_bad_subject"), (~entity, "reject", "owned_by_bad_object"), (~_any(told, OWNERSHIP), "reject", "owned_by_no_ownership_evidence"), (absent, "reject", "owned_by_object_not_in_evidence"), (F.contains(told, F.concat(F.lit("by "), F.col("_s"))), "reject", "owned_by_subject_is_agent")),
        ("develops", "developed_by"): _first((_any(told, NEGATIONS), "reject", "develops_negated"), (bad_s, "reject", "develops_bad_subject"), ((p == "developed_by") & ~entity, "reject", "developed_by_bad_object"), ((p != "developed_by") & ~phrase, "reject", "develops_bad_object"), (absent, "reject", "develops_object_not_in_evidence")),
        ("produces",): _first((bad_s, "reject", "produces_bad_subject"), (~phrase, "reject", "produces_bad_object"), (absent, "reject", "produces_object_not_in_evidence")),
        ("publishes",): _first((bad_s, "reject", "publishes_bad_subject"), (~phrase, "reject", "publishes_bad_object"), (F.contains(F.col("_o"), F.lit("range of")), "quarantine", "publishes_vague_object"), (~named, "quarantine", "publishes_unnamed_publication"), (absent, "reject", "publishes_object_not_in_evidence")),
        ("founded", "founded_by"): _first((bad_s, "reject", "founded_bad_subject"), (~entity, "reject", "founded_bad_object"), (absent, "reject", "founded_object_not_in_evidence")),
        ("is_a",): _first((bad_s, "reject", "is_a_bad_subject"), (F.col("_o").isin(*BROAD_CLASSES), "reject", "is_a_object_too_broad"), ((words >= 2) & F.split(F.col("_o"), " ")[0].isin(*NATIONALITIES), "reject", "is_a_object_truncated_nationality"), (~phrase, "quarantine", "truncated_is_a_object")),
        EVENTS: _first((bad_s, "reject", "event_relation_bad_subject"), ((o == "") | (words > 5), "reject", "event_relation_bad_object"), (absent, "reject", "event_relation_object_not_in_evidence")),
        CONCEPTS: _first((~s.rlike("^[A-Z]") | (F.size(_words(s)) > 6), "reject", "concept_relation_bad_subject"), (~phrase, "reject", "concept_relation_bad_object"), (absent, "reject", "concept_relation_object_not_in_evidence")),
    }
    general = _first((bad_s, "reject", "generic_relation_bad_subject"), (~(entity | phrase), "reject", "generic_relation_bad_object"), (absent, "reject", "generic_relation_object_not_in_evidence"))
    temporal = F.col("_o").isin(*MONTHS) | F.col("_o").rlike("^([0-9]{4}|[0-9]{1,3})$")
    out = F.when(~p.isin(*EVENTS) & temporal, _verdict("reject", "object_is_temporal_word"))
    for predicates, check in checks.items():
        out = out.when(p.isin(*predicates), check)
    return out.otherwise(general)


def _known_for(bad_subject: Column, clear: Column) -> Column:
    return F.when(bad_subject, _verdict("reject", "known_for_bad_subject")).when(clear, _verdict("accept", "")).otherwise(_verdict("quarantine", "known_for_default_quarantine"))


def definition_verdict() -> Column:
    """First gate for definitions: only what the evidence leads with."""
    s, d, told = F.col("_s"), F.col("_o"), F.col("_told")
    lead = F.array_join(F.slice(F.split(d, " "), 1, 3), " ")
    after = F.regexp_replace(F.call_function("substring_index", F.concat(F.lit(" "), told), F.concat(F.lit(" "), s), F.lit(-1)), r"^\s*(?:\([^)]*\))?(?:,\s+also\s+known\s+as\s+[^,]{1,60},)?\s+(?:is|was|are|were)\s+", "=")
    led = F.startswith(after, F.lit("=")) & (F.startswith(F.regexp_replace(after, "^=(?:a |an |the )?", ""), lead) | F.startswith(F.regexp_replace(after, "^=", ""), lead)) & F.contains(F.concat(F.lit(" "), told), F.concat(F.lit(" "), s))
    first = lambda text: F.split(text, " ")[0]
    uneven = F.length(F.regexp_replace("object", r"[^(]", "")) != F.length(F.regexp_replace("object", r"[^)]", ""))
    stone = F.contains(told, F.lit("birthstone"))
    return _first(
        (stone & d.isin(*GEMS) & F.contains(told, d), "property_candidate", "definition_birthstone"),
        (stone, "quarantine", "property_candidate_not_answerable_definition"),
        (s.isin(*GENERIC_SUBJECTS), "reject", "generic_definition_subject"),
        (_any(d, BAD_DEFINITIONS) | first(d).isin(*BAD_LEADS) | first(told).isin(*BAD_LEADS), "reject", "definition_not_lead_style"),
        (uneven, "reject", "truncated_definition"),
        ((d == "") | ~led, "reject", "definition_not_lead_style"),
    )


def relation_verdict_2() -> Column:
    """Second gate: shapes of subjects and objects."""
    s, o, p = F.trim("subject"), F.trim("object"), F.col("_p")
    told = F.col("_told")
    of = lambda *names: p.isin(*names)
    checked = ("headquartered_in", "owned_by", "acquired_by", "develops", "developed_by", "founded_by", "publishes", "produces")
    return _first(
        (of(*VOLATILE), "quarantine", "volatile_predicate"),
        (F.endswith(s, F.lit(",")) | F.contains(s, F.lit(", and ")), "reject", "dangling_comma_subject"),
        (s.rlike(APPOSITION), "reject", "appositive_alias_subject"),
        (reduce(lambda a, x: a | F.startswith(F.lower(s), F.lit(x)), SUBJECT_LEADS, F.lit(False)), "reject", "fragment_prefix_subject"),
        (of(*CORPORATE) & F.col("_s").isin(*PLACES), "reject", "geopolitical_subject_corporate_predicate"),
        (of("headquartered_in") & ~_any(told, ("headquartered in", "headquarters in")), "quarantine", "headquarters_subject_or_clause_uncertain"),
        (of("owned_by", "acquired_by") & F.col("_o").isin(*STATES), "reject", "owned_by_geopolitical_object"),
        (of("developed_by") & F.col("_o").isin(*TOWNS), "reject", "developed_by_location_object"),
        (of("develops") & F.col("_s").isin(*TOWNS), "reject", "develops_location_subject"),
        (of("develops", "developed_by") & o.rlike(ARTIFACTS), "reject", "develops_design_artifact_object"),
        (of("founded_by") & o.rlike(CUT_NAME), "reject", "founded_by_truncated_object"),
        (of("founded_by") & F.col("_o").isin(*GENERIC_ENTITIES), "reject", "founded_by_generic_object"),
        (of("publishes") & s.rlike(PUBLISHER_PHRASE), "reject", "publishes_phrase_subject"),
        (of("produces") & o.rlike(UNIVERSAL), "reject", "produces_universal_object"),
        (~of(*checked) & o.rlike(LONG_TAIL) & (F.col("_n_words") > 5), "quarantine", "object_has_descriptive_tail"),
    )


def definition_verdict_2() -> Column:
    """Second gate for definitions: names with appositions, definitions that are cut off or say next to nothing."""
    s, d = F.trim("subject"), F.trim("object")
    words = _words(d)
    cut = reduce(lambda a, x: a | F.endswith(F.lower(d), F.lit(x)), CUT_ENDINGS, F.lit(False)) | d.rlike(r"\bthe\s+[Uu]\.?\s*$") | ((F.size(words) <= 6) & F.coalesce(F.lower(F.try_element_at(words, F.lit(-1))).isin(*SHORT_ENDS), F.lit(False)))
    noun = F.regexp_extract(F.col("_o"), NATIONALITY_NOUN, 1)
    return _first(
        (s.rlike(APPOSITION), "reject", "appositive_alias_subject"),
        (F.endswith(s, F.lit(",")) | F.contains(s, F.lit(", and ")), "reject", "dangling_comma_subject"),
        (cut, "reject", "truncated_definition"),
        ((noun != "") & ~noun.isin(*ROLES), "reject", "definition_nationality_plus_single_noun"),
    )


def canonical(name: Column) -> Column:
    return reduce(lambda w, kv: w.when(key(name) == kv[0], kv[1]), ALIASES.items(), F.when(F.lit(False), "")).otherwise(key(name))


def relation_verdict_3(is_alias: Column) -> Column:
    """Third gate: ambiguous predicates, aliases, cut names."""
    s, o, p, page = F.trim("subject"), F.trim("object"), F.col("_p"), F.trim(F.coalesce("source_page", F.lit("")))
    single = lambda x: x.rlike("^[A-Z][^A-Z \t]{2,}$")
    short = (F.col("_s") != "") & reduce(lambda a, x: a | F.startswith(key(page), F.concat(F.col("_s"), F.lit(x))), INSTITUTIONS, F.lit(False))
    last = F.coalesce(F.lower(F.try_element_at(_words(page), F.lit(-1))) == F.lower(s), F.lit(False)) & (F.size(_words(page)) >= 2)
    return _first(
        (p == "headquartered_in", "quarantine", "headquartered_in_quarantine_default"),
        ((p == "owned_by") & F.exists(_words(F.lower(s)), lambda w: w.isin(*VEHICLES)), "quarantine", "owned_by_predicate_ambiguous"),
        (is_alias, "quarantine", "duplicate_alias_relation"),
        (p.isin("founded_by", "founded", "developed_by", "develops") & short, "quarantine", "subject_alias_too_short"),
        (p.isin("founded_by", "developed_by") & single(o), "quarantine", "truncated_person_alias"),
        ((p == "develops") & single(s) & last, "quarantine", "truncated_person_alias"),
    )


def definition_verdict_3() -> Column:
    last = F.lower(F.try_element_at(_words(F.regexp_replace(F.trim("object"), "[.,; ]+$", "")), F.lit(-1)))
    return _first((F.coalesce(last.isin(*PARTICIPLES), F.lit(False)), "reject", "definition_truncated_participle"))


def source_verdict() -> Column:
    """Gate of open sources: only a definition that the source's title leads; ``extraction`` and ``source_kind`` may vouch for a relation."""
    lead = key(F.regexp_extract("evidence", LEAD, 1))
    vouched = (F.col("extraction") != "") & F.startswith("extraction", F.concat("source_kind", F.lit("_")))
    bad = F.exists(F.split(key(F.col("object")), " "), lambda w: w.isin(*EVALUATIVE))
    return _first(
        ((F.col("kind") != "definition") & ~vouched, "quarantine", "open_web_relation_requires_source_specific_extractor"),
        ((F.col("kind") == "definition") & ((F.trim("subject") == "") | (key(F.col("subject")) != key(F.col("source_page")))), "reject", "open_web_subject_not_source_title"),
        ((F.col("kind") == "definition") & ((lead == "") | (lead != key(F.col("subject")))), "reject", "open_web_not_direct_title_led_definition"),
        ((F.col("kind") == "definition") & bad, "reject", "open_web_evaluative_or_temporal_definition"),
    )


def judged(items: DataFrame) -> DataFrame:
    """Items with gate, verdict and reason: the first gate that doesn't accept, else the third; null fields count as empty."""
    relation = F.col("kind") == "relation"
    one = F.when(relation, relation_verdict()).otherwise(definition_verdict())
    two = F.when(relation, relation_verdict_2()).otherwise(definition_verdict_2())
    # written once: the groups of aliases and the items both read it, and the checks stay out of later plans
    rows = cut(prepared(items).withColumn("_c", canonical(F.col("object"))).withColumns({"_one": one, "_two": two}))
    passed = rows.where(relation & (F.col("_one") == ACCEPT) & (F.col("_two") == ACCEPT))
    several = passed.groupBy("_s", "_p", "_c").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = rows.join(several, ["_s", "_p", "_c"], "left")
    three = F.when(relation, relation_verdict_3(F.col("_n").isNotNull() & (key(F.col("object")) != F.col("_c")))).otherwise(definition_verdict_3())
    first = F.when(F.col("_one") != ACCEPT, F.col("_one")).when(F.col("_two") != ACCEPT, F.col("_two")).otherwise(F.col("_three"))
    gate = F.when(F.col("_one") != ACCEPT, 1).when(F.col("_two") != ACCEPT, 2).otherwise(3)
    out = rows.withColumn("_three", three).withColumns({"gate": gate, "_f": first})
    return out.select(*items.columns, "gate", F.substring_index("_f", ":", 1).alias("verdict"), F.substring_index("_f", ":", -1).alias("reason"))
