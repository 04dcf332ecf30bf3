"""Relations from sentences: patterns between two names, cleaning, screens, validation, and the quality of nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A name-like phrase, shortest first.
NAME = r"[A-Za-z0-9][A-Za-z0-9 ,.\-'&]{0,60}?"
# Nouns of a company clause, kinds and nouns of a class, offices, and amounts of money.
_COMPANY = "company|corporation|manufacturer|provider|firm|startup|organization|service|platform|conglomerate|publication|agency|enterprise|group"
_KINDS = (
    r"aerospace|automotive|clean\s+energy|electric\s+vehicle|neurotechnology|space\s+exploration|spaceflight|artificial\s+intelligence|information\s+technology|satellite|"
    r"telecommunications|software|hardware|internet|broadband|media|news|financial|investment|business\s+magazine|transport|infrastructure|construction|tunneling|mining|energy|utility"
)
_CLASS = "company|corporation|manufacturer|provider|firm|startup|organization|service|constellation|conglomerate|magazine|publication|platform|agency|authority|enterprise|group"
_AMOUNT = r"((?:\$|USD\s*)?\d[\d.,]*\s*(?:billion|million|trillion|B|M|T)?)"
_OFFICE = r"(?:ceo|chief\s+executive\s+officer|president|chairman|chairperson|head|director\s+general|managing\s+director)"
# Fixed values: (pattern, relation, what stands between the two names, confidence, stability, risk), surest first.
# A form in <> is a whole pattern, in which A and B stand for the names.
_FORMS = (
    ("founded_by_passive", "founded_by", r"was\s+founded\s+by", "high", "semi_stable", "medium"),
    ("founded_by_passive_in_year", "founded_by", r"was\s+founded\s+(?:in\s+\d{4}\s+)?by", "high", "semi_stable", "medium"),
    ("founded_active", "founded", r"founded", "high", "semi_stable", "medium"),
    ("is_founded_by", "founded_by", r"is\s+founded\s+by", "high", "semi_stable", "medium"),
    ("founded_by_reduced_company_clause", "founded_by", r"<\bA(?:\s+\([^)]{0,40}\))?\s+is\s+(?:an?\s+|the\s+)[^.]{0,160}?\b(?:" + _COMPANY + r")\s+founded\s+by\s+B\b>", "high", "semi_stable", "medium"),
    ("developed_by_passive", "developed_by", r"(?:was|is|were)\s+developed\s+by", "high", "semi_stable", "medium"),
    ("develops_active", "develops", r"(?:develops?|developed)", "high", "semi_stable", "medium"),
    ("designed_and_manufactured_by", "developed_by", r"(?:was|is)\s+designed\s+and\s+manufactured\s+(?:in\s+[A-Za-z ]+\s+)?by", "high", "semi_stable", "medium"),
    ("manufactured_by_passive", "developed_by", r"(?:was|is|are)\s+manufactured\s+by", "high", "semi_stable", "medium"),
    ("manufactures_active", "manufactures", r"manufactures?", "high", "semi_stable", "medium"),
    ("designs_manufactures_sells", "manufactures", r"(?:designs?,\s*)?manufactures?,?\s+(?:and\s+)?sells?", "high", "semi_stable", "medium"),
    ("produces_active", "produces", r"produces?", "medium", "semi_stable", "medium"),
    ("is_product_of", "product_of", r"is\s+a\s+(?:product|offering)\s+of", "high", "semi_stable", "medium"),
    ("is_service_of", "service_of", r"is\s+a\s+(?:service|division)\s+of", "high", "semi_stable", "medium"),
    ("is_platform_of", "platform_of", r"is\s+a\s+platform\s+of", "high", "semi_stable", "medium"),
    ("is_subsidiary_of", "subsidiary_of", r"is\s+a\s+(?:wholly[\s-]owned\s+)?subsidiary\s+of", "high", "semi_stable", "medium"),
    ("subsidiary_clause", "subsidiary_of", r"<\bA,\s+a\s+(?:wholly[\s-]owned\s+)?subsidiary\s+of\s+B,>", "high", "semi_stable", "medium"),
    ("is_owned_by", "owned_by", r"is\s+owned\s+by", "high", "semi_stable", "medium"),
    ("acquired_by", "owned_by", r"was\s+acquired\s+by", "medium", "semi_stable", "medium"),
    ("parent_company_of", "parent_company_of", r"is\s+the\s+parent\s+company\s+of", "high", "semi_stable", "medium"),
    ("headquartered_in", "headquartered_in", r"(?:is\s+)?headquartered\s+(?:in|at)", "high", "semi_stable", "low"),
    ("headquartered_in_city", "headquartered_in", r"<[Hh]eadquartered\s+in\s+([A-Z][A-Za-z ,]+?),\s+A\b>", "medium", "semi_stable", "low"),
    ("is_operated_by", "owned_by", r"(?:is\s+)?operated\s+by", "high", "semi_stable", "medium"),
    ("operates_active", "operates", r"operates?", "medium", "semi_stable", "medium"),
    ("created_by_passive", "created_by", r"was\s+created\s+by", "high", "semi_stable", "medium"),
    ("published_by_passive", "published_by", r"(?:was|is)\s+published\s+by", "high", "semi_stable", "medium"),
    ("is_part_of", "part_of", r"is\s+(?:a\s+)?part\s+of", "medium", "semi_stable", "medium"),
    ("uses_active", "uses", r"uses?", "medium", "semi_stable", "medium"),
    ("provides_active", "provides", r"provides?", "medium", "semi_stable", "medium"),
    ("enables_active", "enables", r"enables?", "medium", "semi_stable", "medium"),
    ("used_for_passive", "used_for", r"(?:is|are|was|were)\s+used\s+for", "medium", "semi_stable", "medium"),
    ("works_by_mechanism", "works_by", r"works?\s+(?:by|through)", "medium", "semi_stable", "medium"),
    ("is_a_type", "is_a", r"<\bA,?\s+(?:Inc\.?|Corp\.?|LLC\.?|Ltd\.?)?\s*(?:\([^)]{0,40}\))?\s*is\s+(?:an?\s+|the\s+)((?:American|international|global|multinational|private|public)?\s*(?:" + _KINDS + r")\s*(?:" + _CLASS + r")?)\b>", "high", "stable", "low"),
    ("is_ceo_of", "leader_of", r"is\s+(?:the\s+)?" + _OFFICE + r"\s+of", "high", "volatile", "high"),
    ("serves_as_ceo_of", "leader_of", r"(?:serves?|served)\s+as\s+(?:the\s+)?(?:ceo|chief\s+executive\s+officer|president|chairman|head|director)\s+of", "high", "volatile", "high"),
    ("leads_active", "leader_of", r"(?:leads?|chairs?)", "medium", "volatile", "high"),
    ("valued_at_passive", "valued_at", r"<\bA\s+(?:is|was|has\s+been)\s+valued\s+at\s+" + _AMOUNT + r"\b>", "high", "volatile", "high"),
    ("has_valuation_of", "valued_at", r"<\bA\s+(?:has|had)\s+a\s+valuation\s+of\s+" + _AMOUNT + r"\b>", "high", "volatile", "high"),
)


def pattern_regex(form: str) -> str:
    """Regular expression of a form; both names are groups, in the order in which they stand."""
    if form.startswith("<"):
        return "(?i)" + form[1:-1].replace(r"\bA", rf"\b({NAME})").replace(r"\s+A\b", rf"\s+({NAME})\b").replace(r"\s+B", rf"\s+({NAME})")
    return rf"(?i)\b({NAME})\s+{form}\s+({NAME})\b"


#: (pattern, relation, regular expression, group of the subject, confidence, stability, risk)
PATTERNS = tuple((name, relation, pattern_regex(form), 2 if name == "headquartered_in_city" else 1, *rest) for name, relation, form, *rest in _FORMS)
# What stands in every match of a pattern, in lower case; a pattern is looked for only where it stands.
STEMS = {
    "founded_by_passive": "founded", "founded_by_passive_in_year": "founded", "founded_active": "founded", "is_founded_by": "founded", "founded_by_reduced_company_clause": "founded", "developed_by_passive": "developed",
    "develops_active": "develop", "designed_and_manufactured_by": "manufactured", "manufactured_by_passive": "manufactured", "manufactures_active": "manufacture", "designs_manufactures_sells": "sell", "produces_active": "produce",
    "is_product_of": "of", "is_service_of": "of", "is_platform_of": "platform", "is_subsidiary_of": "subsidiary", "subsidiary_clause": "subsidiary", "is_owned_by": "owned", "acquired_by": "acquired", "parent_company_of": "parent",
    "headquartered_in": "headquartered", "headquartered_in_city": "eadquartered", "is_operated_by": "operated", "operates_active": "operate", "created_by_passive": "created", "published_by_passive": "published", "is_part_of": "part",
    "uses_active": "use", "provides_active": "provide", "enables_active": "enable", "used_for_passive": "used", "works_by_mechanism": "work", "is_a_type": "is", "is_ceo_of": "of", "serves_as_ceo_of": "serve", "leads_active": "a",
    "valued_at_passive": "valued", "has_valuation_of": "valuation",
}
# Sentences that are never trusted, by reason.
SCREENS = (
    ("current_or_live_claim", r"(?i)\b(current\s+(?:ceo|president|chairman|chief|leader|stock\s+price|price|valuation|market\s+cap)|stock\s+price|share\s+price|market\s+cap(?:italization)?|net\s+worth|latest\s+(?:revenue|ranking|quarterly)|quarterly\s+revenue|right\s+now|as\s+of\s+today|currently\s+(?:serves?|is\s+the|holds?)|today'?s|live\s+(?:market|price|data))\b"),
    ("private_or_sensitive", r"(?i)\b(phone\s+number|home\s+address|private\s+email|date\s+of\s+birth|social\s+security|passport\s+number)\b"),
    ("unsupported_universal", r"(?i)\b(all\s+\w+\s+are\b|is\s+every\b|are\s+all\b|every\s+\w+\s+is\b)\b"),
)
# Words that end a capture wrongly, that refer back, and that say nothing alone.
TRAILING = r"(?i)\s+(?:and|or|with|for|in|on|at|by|of|to|the|a|an|its|their|which|that)$"
POINTING = ("this", "these", "that", "those")
AUXILIARY = "can could will would may might shall should must is are was were has have had does do".split()
BARE = "it he she they its the a an this that".split()
MOST_WORDS = 8


def cleaned(name: Column) -> Column:
    """A captured name without punctuation and a relational word at its end."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), r"[., ;:)]+$", ""), TRAILING, ""))


def too_generic(name: Column) -> Column:
    low = F.lower(name)
    words = F.split(low, r"\s+")
    several = F.size(words) > 1
    return (F.length(low) < 3) | low.isin(*BARE) | (several & (F.element_at(words, 1).isin(*POINTING) | F.element_at(words, -1).isin(*AUXILIARY)))


def screen_reasons(sentence: Column) -> Column:
    """Reasons not to trust a sentence, in a fixed order."""
    return F.array_compact(F.array(*(F.when(sentence.rlike(pattern), name) for name, pattern in SCREENS)))


def candidates(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent, pattern_id, subject, relation, object, confidence, stability, risk, screens, sentence).

    ``sentences`` is (doc_id, sent, sentence). All matches of all patterns count; of equal
    triples of a document the first stays, by sentence number, pattern, place and sentence. A screened
    sentence gives candidates of low confidence. Null sentences give none.
    """
    text, low = F.col("sentence"), F.col("_low")

    def matched(k: int, name: str, pattern: str, first: int) -> Column:
        # names are taken from the few characters of a match, and cleaned there, so each is cleaned once however many filters follow
        part = lambda m, group: cleaned(F.regexp_extract(m, pattern, group))
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, at: F.struct(F.lit(k).alias("k"), at.alias("place"), part(m, first).alias("subject"), part(m, 3 - first).alias("object")))
        # what follows the first name must be there; only then the name before it is looked for
        there = low.contains(STEMS[name]) & text.rlike(pattern.replace(rf"\b({NAME})", "", 1))
        return F.when(there, found).otherwise(F.array().cast("array<struct<k:int,place:int,subject:string,object:string>>"))

    found = F.concat(*(matched(k, p[0], p[2], p[3]) for k, p in enumerate(PATTERNS)))
    rows = sentences.where(text.isNotNull()).select("doc_id", "sent", "sentence", F.lower("sentence").alias("_low"))
    rows = rows.select("doc_id", "sent", "sentence", F.explode(found).alias("m")).select("doc_id", "sent", "m.place", "sentence", "m.k", "m.subject", "m.object")
    for name in ("subject", "object"):
        rows = rows.where((F.col(name) != "") & ~too_generic(F.col(name)) & (F.size(F.split(name, r"\s+")) <= MOST_WORDS))
    of = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("pattern_id", "relation", "confidence", "stability", "risk"), (p[0], p[1], *p[4:]), strict=True))) for p in PATTERNS))
    rows = rows.withColumn("p", F.element_at(of, F.col("k") + 1)).select("*", "p.pattern_id", "p.relation", "p.confidence", "p.stability", "p.risk").drop("p")
    rows = rows.where((F.col("relation") != "is_a") | (F.lower("subject") != F.lower("object")))
    order = Window.partitionBy("doc_id", F.lower("subject"), "relation", F.lower("object")).orderBy("sent", "k", "place", "sentence")
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    screens = F.array_join(screen_reasons(text), ";")
    confidence = F.when(screens != "", "low").otherwise(F.col("confidence"))
    return rows.select("doc_id", "sent", "pattern_id", "subject", "relation", "object", confidence.alias("confidence"), "stability", "risk", screens.alias("screens"), "sentence")


# Relations by the kinds of things they may hold between.
ORGANIZATION_SUBJECT = ("manufactures", "produces", "develops", "operates", "parent_company_of", "subsidiary_of", "headquartered_in", "industry")
NO_PERSON_SUBJECT = ("founded_by", "owned_by", "subsidiary_of", "service_of", "platform_of", "product_of", "part_of")
NO_PERSON_OBJECT = ("founded", "develops", "manufactures", "produces", "operates", "product_of", "service_of", "platform_of", "part_of", "headquartered_in", "industry", "trained_on", "based_on", "extends")
# Beginnings of a subject that is a piece of a sentence, and words that are no names.
FRAGMENT = r"(?i)^(In\s+\w+|As\s+of|Following|During|By\s+\w+|On\s+\w+|History|Founding|Background|Meanwhile|Currently|According|After|Before|Since|While|When|Later|Soon|Also|However|From|Until|Between|Among|Several|Three|Two|One|For|Although)"
NO_NAMES = (
    "and or the a an its it more many some most several nearly about seven five multiple various advanced new large small global american international modern early artificial further "
    "additional key major certain fixed both other different significant numerous unique all each any specific former primary main full including excellent good devices torque information "
    "data services products components features materials technologies operations missions flights systems capabilities models approximately extensive commercial"
).split()
# Relations that say the same, the same the other way round, and the opposite the other way round.
SAME = {"manufactures": ("manufactures", "produces"), "produces": ("produces", "manufactures"), "is_a": ("is_a", "type_of"), "type_of": ("type_of", "is_a")}
TWIN = {"founded_by": "founded", "founded": "founded_by"}
OPPOSITE = {"owned_by": "owns", "subsidiary_of": "parent_company_of", "parent_company_of": "subsidiary_of"}
MOST_NAME_WORDS = 7


def _is_capital(name: Column) -> Column:
    return name.rlike(r"^[A-Z]")


def _plain_name(name: Column, known: Column, most: int) -> Column:
    return known | (_is_capital(name) & ~name.rlike(r"[0-9,]") & (F.size(F.split(name, r"\s+")) <= most))


def _hits(existing: DataFrame) -> DataFrame:
    """(_s, relation, _o, _hit): the candidates that known triples make duplicates or conflicts; each triple is turned into those it meets, so candidates are read once."""
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    met = lambda relation, what, subject, object_: F.struct(subject.alias("_s"), relation.alias("relation"), object_.alias("_o"), F.lit(what).alias("_hit"))
    meets = [F.when(~p.isin(*SAME), met(p, "duplicate", s, o))]
    meets += [F.when(p == q, met(F.lit(r), "duplicate", s, o)) for r, same in SAME.items() for q in same]
    meets += [F.when(p == q, met(F.lit(r), what, o, s)) for pairs, what in ((TWIN, "duplicate"), (OPPOSITE, "conflict")) for r, q in pairs.items()]
    own = existing.select(F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("o"))
    return own.select(F.explode(F.array_compact(F.array(*meets))).alias("m")).select("m.*").groupBy("_s", "relation", "_o").agg(F.max("_hit").alias("_hit"))


def validated(found: DataFrame, surfaces: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates with subject and object resolved, ``verdict`` (safe, quarantine, duplicate or conflict) and all ``reasons``, in order of name.

    ``surfaces`` is (surface, canonical, type), one row for each surface in lower case; ``existing`` is
    (subject, predicate, object). Joins by name and by triple; nothing is looked up row by row.
    """
    for side in ("subject", "object"):
        names = surfaces.select(F.col("surface").alias("_k"), F.col("canonical").alias(f"_{side}"), F.col("type").alias(f"_{side}_type"))
        found = found.join(names, F.lower(side) == F.col("_k"), "left").drop("_k")
        found = found.withColumns({side: F.coalesce(f"_{side}", side), f"_{side}_known": F.col(f"_{side}").isNotNull()}).drop(f"_{side}")
    subject, object_, relation = F.col("subject"), F.col("object"), F.col("relation")
    known_s, known_o = F.col("_subject_known"), F.col("_object_known")

    def weak(name: Column, known: Column) -> Column:
        words = F.split(name, r"\s+")
        single = (F.size(words) == 1) & (F.lower(F.regexp_replace(name, r"[.,;:)]+$", "")).isin(*NO_NAMES) | (~_is_capital(name) & ~known))
        lone = (F.size(words) == 1) & name.rlike("^[A-Z][A-Za-z]*$") & ~known
        return (F.length(name) < 2) | (F.size(words) > MOST_NAME_WORDS) | single | lone

    missing = weak(subject, known_s) | weak(object_, known_o) | ~_plain_name(subject, known_s, 5) | ~_plain_name(object_, known_o, 6) | subject.rlike(FRAGMENT)
    person_s, person_o = (F.coalesce(F.col(f"_{side}_type"), F.lit("")) == "person" for side in ("subject", "object"))
    unknown = ~known_s & ~known_o & (F.col("confidence") == "low")
    reasons = F.array_compact(
        F.array(
            F.when(relation.isin(*ORGANIZATION_SUBJECT) & person_s, "directionality_conflict"),
            F.when((relation.isin(*NO_PERSON_SUBJECT) & person_s) | (relation.isin(*NO_PERSON_OBJECT) & person_o), "entity_type_conflict"),
            F.when(unknown, "generic_entity_match"),
            F.when(missing, "missing_explicit_evidence"),
        )
    )
    reasons = F.array_union(reasons, F.filter(F.split("screens", ";"), lambda s: s != ""))
    reasons = F.when((F.size(reasons) == 0) & (F.col("confidence") == "low"), F.array(F.lit("low_confidence"))).otherwise(F.array_sort(reasons))
    found = found.withColumns({"_s": F.lower("subject"), "_o": F.lower("object"), "_reasons": reasons})
    out = found.join(_hits(existing), ["_s", "relation", "_o"], "left")
    verdict = F.coalesce("_hit", F.when(F.size("_reasons") > 0, "quarantine").otherwise("safe"))
    return out.select("doc_id", "sent", "pattern_id", "subject", "relation", "object", "confidence", verdict.alias("verdict"), F.array_join("_reasons", ";").alias("reasons"))


# Authors speaking of their own work, names of deeds, and heads of phrases that name nothing.
AUTHORS = r"(?i)^(?:we|our\s+(?:approach|method|system|framework|model)|this\s+(?:paper|study|work)|(?:the\s+)?proposed\s+(?:method|approach|system|framework|model))$"
DEEDS = r"(?i)^(?:identifying|achieving|providing|allowing|using|training|testing|benchmarking|composing)\b|\b(?:to\s+(?:achieve|compose|identify|provide)|can\s+be|being)\b"
GENERIC_HEADS = (
    "activity approach challenge challenges classification data framework information method methods model models object objects outcome outcomes paper performance property security "
    "service services study system systems technique techniques uncertainties users vulnerabilities work"
).split()


def node_reasons(subject: Column, object_: Column, sentence: Column, subject_known: Column, object_known: Column) -> Column:
    """Reasons, in order of name, for which a triple's ends are no nodes of a graph; empty for good ones."""

    def of(name: Column, known: Column) -> list[Column]:
        tail = F.regexp_extract(F.lower(name), r"([a-z][a-z-]*)[^a-z]*$", 1)
        named = F.exists(F.slice(F.split(name, r"\s+"), 2, 1000), lambda w: w.rlike("^[A-Z]"))
        after = F.when(F.instr(sentence, ":") > 0, F.substring(sentence, F.instr(sentence, ":") + 1, F.length(sentence))).otherwise("")
        listed = F.contains(after, F.lit(",")) & F.contains(F.lower(after), F.lower(name))
        return [F.when(name.rlike(DEEDS), "event_like_node"), F.when(tail.isin(*GENERIC_HEADS) & ~named, "generic_abstract_node"), F.when(listed, "list_derived_context"), F.when(~known, "unresolvable_entity")]

    own = [F.when(subject.rlike(AUTHORS), "authorial_self_reference"), *of(subject, subject_known), *of(object_, object_known)]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*own))))
