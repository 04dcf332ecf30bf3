"""Facts from sentences by patterns that take whole clauses and then look for names in them.

A pattern is looked for only where one of its words stands, once, and as a whole; its parts are then taken from the few
characters that it matched. Patterns, screens and lists are fixed values.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NAME = r"[A-Z][A-Za-z0-9 ,.'&\-]{1,59}?"
_LONG = r"[A-Z][A-Za-z0-9 ,.'&\-]{1,80}?"
_BY_END = r"(?=\s+in\s+\d{4}|\s*[.,;]|$)"
_OR_IT = rf"\b({_NAME}|it)"


class Pattern(NamedTuple):
    """One of the words in ``word``, parted by bars, must stand in the sentence in lower case; groups: subject, object. ``names`` tells how objects are found in the clause."""

    id: str
    predicate: str
    word: str
    regex: str
    names: str = "whole"
    subject: str = "name"
    risk: str = "medium"
    stability: str = "semi_stable"
    inverse: bool = False


# The patterns, in order. Subjects: a name; a name or, for what isn't one, the page; always the page.
PATTERNS = (
    Pattern("founded_by_v2", "founded_by", "founded", rf"(?i)\b({_NAME})\s+was\s+founded\s+(?:in\s+\d{{4}}\s+)?by\s+([A-Za-z][^.!?\n]{{0,120}}?){_BY_END}", "persons"),
    Pattern("subsidiary_of_v2", "subsidiary_of", "subsidiary", rf"\b({_NAME})\s+is\s+a\s+(?:[a-z][A-Za-z0-9 ,]{{0,80}}?\s+)?subsidiary\s+of\s+({_NAME})(?=[,. ]|$)", "capital"),
    Pattern("service_of_v2", "service_of", "division|service|arm|unit|branch", rf"\b({_NAME})\s+is\s+a\s+(?:[a-z][A-Za-z0-9 ,]{{0,80}}?\s+)?(?:division|service|arm|unit|branch)\s+of\s+({_NAME})(?=[,. ]|$)", "capital"),
    Pattern("lead_definition_v2", "is_a", " is | are | was | were ", rf"(?:Sir|Dame|Dr\.?|Professor|Prof\.?)?\s*({_LONG})(?:\s*\([^)]{{0,80}}\))?(?:,\s+also\s+known\s+as\s+[^,]{{1,60}},)?\s+(?:is|are|was|were)\s+(?:a|an|the)\s+([A-Za-z][A-Za-z0-9 \-']{{2,80}}?)(?=[,.]|\s+(?:and\b|that\b|which\b|who\b|founded\b|based\b|best\s+known\b|known\b|located\b|headquartered\b|serving\b|formerly\b|also\b)|$)", "definition", risk="low", stability="stable"),
    Pattern("publishes_named_v2", "publishes", "including", rf"(?i)\b({_NAME})\s+publishes?\s+.{{0,120}}?including\s+the\s+(?:[a-z]+\s+)?([A-Z][A-Za-z0-9 ]{{1,59}}?)(?=[,.]|$)", "capital"),
    Pattern("publishes_direct_v2", "publishes", "publish", rf"\b({_NAME})\s+publishes?\s+(?:the\s+)?(?:[a-z]+\s+){{0,2}}([A-Z][A-Za-z0-9 ]{{1,59}}?)(?=[,.]|$)", "work"),
    Pattern("developed_by_v2", "developed_by", "developed|created|built|designed", rf"(?i)\b({_NAME})\s+(?:was|is|were)\s+(?:developed|created|built|designed)\s+by\s+([A-Za-z][^.!?\n]{{0,120}}?){_BY_END}", "entities"),
    Pattern("develops_inverse_v2", "develops", "developed|created|built|designed", rf"(?i)\b({_NAME})\s+(?:was|is|were)\s+(?:developed|created|built|designed)\s+by\s+([A-Za-z][^.!?\n]{{0,120}}?){_BY_END}", "entities", inverse=True),
    Pattern("manufactured_by_v2", "produces", "manufactured", rf"(?i)\b({_NAME})\s+(?:was|is|were)\s+manufactured\s+by\s+([A-Za-z][^.!?\n]{{0,120}}?){_BY_END}", "entities", inverse=True),
    Pattern("operated_by_v2", "operated_by", "operated", rf"(?i)\b({_NAME})\s+(?:was|is|were)\s+operated\s+by\s+([A-Za-z][^.!?\n]{{0,120}}?){_BY_END}", "entities"),
    Pattern("owned_by_v2", "owned_by", "owned", rf"(?i)\b({_NAME})\s+(?:was|is|were)\s+owned\s+by\s+([A-Za-z][^.!?\n]{{0,120}}?){_BY_END}", "entities"),
    Pattern("acquired_by_v2", "owned_by", "acquired", rf"(?i)\b({_NAME})\s+(?:was|is|were)\s+acquired\s+by\s+([A-Za-z][^.!?\n]{{0,120}}?){_BY_END}", "entities"),
    Pattern("acquired_active_v2", "owned_by", "acquired", rf"\b({_NAME})\s+acquired\s+({_NAME}){_BY_END}", "name", inverse=True),
    Pattern("headquartered_in_v2", "headquartered_in", "headquartered", rf"\b({_NAME})\s+(?:is\s+)?headquartered\s+(?:in|at)\s+([A-Z][A-Za-z, ]{{1,59}}?)(?=[,.]|$)", "capital", risk="low"),
    Pattern("marketed_as_v2", "marketed_as", "marketed", rf"(?i)\b({_NAME})(?:\s*\([^)]{{0,120}}\))?,?\s+(?:also\s+)?marketed\s+as\s+([^.;]{{1,160}}?)(?=,?\s+(?:is|was)\b|[.;]|$)", "aliases", "or_page", "low"),
    Pattern("alias_v2", "alias", "known|nicknamed", rf"(?i)\b({_NAME})(?:\s*\([^)]{{0,120}}\))?,?\s+(?:also\s+known\s+as|formerly\s+known\s+as|nicknamed)\s+([^.;]{{1,160}}?)(?=,?\s+(?:is|was)\b|[.;]|$)", "aliases", "or_page", "low"),
    Pattern("funded_by_v2", "funded_by", "funded", rf"\b({_LONG}|Design\s+of\s+this\s+version)\s+(?:was|were)\s+funded\s+by\s+({_NAME})(?=\s+with\b|[,.]|$)", "whole", "or_page", "low", "stable"),
    Pattern("located_in_v2", "located_in", " in ", rf"\b({_NAME})(?:\s*\([^)]{{0,120}}\))?\s+(?:is|was)\s+(?:an?\s+|the\s+)?.{{0,140}}?\s+in\s+((?:unincorporated\s+)?[A-Z][A-Za-z ,.'\-]{{1,80}}?)(?=,\s+(?:just|near|and|which)\b|[.;]|$)", "whole", "or_page", "low"),
    Pattern("based_at_v2", "based_at", "based", rf"\b({_NAME})\s+(?:was|is)\s+[^.]{{0,80}}?\bbased\s+at\s+(?:the\s+)?({_LONG})(?=,\s+|[.;]|$)", "whole", "or_page", "low"),
    Pattern("introduced_v2", "introduced", "introduced", rf"\b({_NAME})\s+(?:was\s+)?introduced\s+in\s+((?:18|19|20)\d{{2}})\b", "whole", "or_page", "low", "stable"),
    Pattern("first_released_v2", "first_released", "eleased", r"(?i)\b((?:first\s+)?released)\s+in\s+((?:18|19|20)\d{2})\b", "whole", "page", "low", "stable"),
    Pattern("construction_started_v2", "construction_started", "onstruction", r"(?i)\b(construction)\s+began\s+in\s+([A-Z][A-Za-z]+\s+(?:18|19|20)\d{2})\b", "whole", "page", "low", "stable"),
    Pattern("ceased_operations_v2", "ceased_operations", "ceased", rf"\b({_NAME})\s+ceased\s+operations\s+in\s+((?:18|19|20)\d{{2}})\b", "whole", "or_page", "low", "stable"),
    Pattern("filed_for_bankruptcy_v2", "filed_for_bankruptcy", "bankruptcy", rf"\b({_NAME})\s+filed\s+for\s+(Chapter\s+\d+\s+bankruptcy)\b", "whole", "or_page", "low", "stable"),
    Pattern("merged_with_v2", "merged_with", "merged", rf"(?i){_OR_IT}\s+merged\s+[^.]{{0,80}}?\bwith\s+([^.;]{{1,160}}?)\s+to\s+form\s+[A-Z][A-Za-z0-9 ,.'&\-]{{1,59}}\b", "entities", "or_page", "low", "stable"),
    Pattern("supports_v2", "supports", "supports", rf"(?i){_OR_IT}\s+supports\s+([^.;]{{1,120}}?)(?=,\s+(?:including|all)\b|[.;]|$)", "whole", "or_page", "low"),
    Pattern("provides_v2", "provides", "provides", rf"(?i){_OR_IT}\s+provides\s+([^.;]{{1,120}}?)(?=,\s+(?:including|using|through|by)\b|[.;]|$)", "whole", "or_page", "low"),
    Pattern("uses_v2", "uses", "uses", rf"(?i){_OR_IT}\s+uses\s+([^.;]{{1,120}}?)(?=\s+to\b|,\s+(?:including|for|and)\b|[.;]|$)", "whole", "or_page", "low"),
    Pattern("enables_v2", "enables", "enables", rf"(?i){_OR_IT}\s+enables\s+([^.;]{{1,120}}?)(?=,\s+(?:including|by|through)\b|[.;]|$)", "whole", "or_page", "low"),
    Pattern("used_for_v2", "used_for", "used", rf"(?i){_OR_IT}\s+(?:is|are|was|were)\s+used\s+for\s+([^.;]{{1,120}}?)(?=,\s+(?:including|by|through)\b|[.;]|$)", "whole", "or_page", "low"),
    Pattern("works_by_v2", "works_by", "works", rf"(?i){_OR_IT}\s+works\s+(?:by|through)\s+([^.;]{{1,120}}?)(?=,\s+(?:including|and)\b|[.;]|$)", "whole", "or_page", "low"),
    Pattern("runs_on_v2", "runs_on", "runs", rf"(?i){_OR_IT}\s+runs\s+on\s+([^.;]{{1,160}})", "platforms", "or_page", "low"),
    Pattern("offers_v2", "offers", "offered", rf"(?i){_OR_IT}\s+is\s+also\s+offered\s+(?:inside|on)\s+([^.;]{{1,160}})", "entities", "or_page", "low"),
    Pattern("hosted_flight_to_v2", "hosted_flight_to", "cargo", rf"\b({_NAME})\s+flew\s+\d+\s+cargo\s+missions\s+to\s+(?:the\s+)?([A-Z][A-Za-z0-9 ()]{{1,59}}?)(?=\s+between\b|[.;]|$)", "whole", "or_page", "low", "stable"),
    Pattern("has_facility_v2", "has_facility", "customs", r"\b([Aa]n?\s+[a-z][A-Za-z0-9 \-]{1,59})\s+is\s+[^.]{0,80}?\bwith\s+(customs\s+and\s+border\s+control\s+facilities)\b", "whole", "page", "low"),
)
# Screens of sentences; the first one doesn't look at a clause ", not designed to …,".
ASIDE = r"(?i),\s*not\s+designed\s+to\s+[^,]+,"
NEGATED = r"(?i)\b(?:not|never|no\s+longer|wasn't|weren't|isn't|aren't|hadn't|cannot|can't|won't|wouldn't|shouldn't|couldn't|mustn't)\b"
UNSAFE = (
    r"(?i)\b(?:currently|today|right\s+now|as\s+of\s+today|current\s+(?:ceo|president|chairman|chief|leader|head|director|owner)|stock\s+price|share\s+price|market\s+cap(?:italization)?"
    r"|net\s+worth|latest\s+(?:revenue|ranking)|quarterly\s+revenue|live\s+(?:market|price|data))\b"
    r"|\b(?:phone\s+number|home\s+address|private\s+email|date\s+of\s+birth|social\s+security|passport\s+number)\b"
    r"|\b(?:all\s+\w+\s+are\b|is\s+every\b|are\s+all\b|every\s+\w+\s+is\b)\b|\b(?:202[3-9])\b"
)
#: In lower case one of these stands wherever the screens above match.
STEMS = ("not", "never", "longer", "n't", "currently", "today", "right", "current", "price", "market", "worth", "latest", "quarterly", "live", "phone", "address", "email", "birth", "security", "passport", "all", "every", "202")
# Words that begin a piece of a sentence, nouns that name nothing, prefixes of pieces, subjects that stand for the page.
STARTERS = (
    "in", "on", "at", "from", "when", "what", "while", "with", "after", "before", "during", "following", "therefore", "although", "however", "since", "is", "are", "was", "were", "they", "this", "that",
    "he", "she", "it", "his", "her", "their", "its", "headquartered", "incorporated", "established", "founded", "known", "located", "based", "owned", "operated", "history", "background", "overview",
    "today", "currently", "previously", "originally", "formerly", "initially", "eventually", "by", "as", "under", "through", "between", "among", "within", "alongside", "together", "later", "soon",
    "also", "meanwhile", "nonetheless", "instead", "further", "moreover", "if", "many",
)
GENERIC = (
    "company", "corporation", "manufacturer", "provider", "service", "platform", "organization", "entity", "firm", "startup", "system", "program", "project", "network", "model", "product", "vehicle",
    "technology", "business", "enterprise", "group", "consortium", "association", "agency", "institute", "foundation",
)
PIECE = r"(?i)^(?:the\s+(?:original|former|late|new|old|current|first|second)\b|the\s+following\b|history\s+of\b)"
PAGE_WORDS = ("it", "this version", "design of this version")
PAGE_MARKS = (",", " and ", " closed ", " doors ", " development team")
# Names of persons and of other things; what ends a definition; definitions that say nothing.
PERSON = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}"
ENTITY = r"[A-Z][A-Za-z0-9&.'\-]*(?:\s+(?:&\s+)?[A-Z][A-Za-z0-9&.'\-]*){0,5}"
DEFINITION_END = r"(?i)\s+(?:and\b|or\b|that\b|which\b|who\b|with\b|through\b|founded\b|based\b|best\s+known\b|known\b|located\b|headquartered\b|developed\b|owned\b|operated\b|manufactured\b|serving\b|offering\b|also\b|originally\b|currently\b|formerly\b).*$"
BROAD = ("artificial intelligence", "american infrastructure", "good thing")
EMPTY_PHRASES = ("award winner", "entrepreneur of the year", "third son", "good thing", "proposal to rename", "winner in the")
LOOSE_HEADS = ("artificial", "american", "british", "canadian", "german", "french")
FIRM_HEADS = (
    "company", "manufacturer", "studio", "organization", "agency", "engineer", "entrepreneur", "publication", "newspaper", "provider", "service", "philanthropist", "businessman", "businesswoman",
    "magnate", "billionaire", "investor", "politician", "executive", "scientist", "author", "journalist", "activist", "founder", "inventor", "diplomat", "academic", "professor", "economist",
    "architect", "designer", "filmmaker", "attorney", "lawyer",
)
# What hangs at the end of a clause that was cut.
HANGING = (
    r"(?i)\s+(?:that|which|who|whom|whose)\b.+$",
    r"(?i)\s+(?:to|for|from|with|by|in|on|at)\s+(?:the\s+)?[A-Z]\s*$",
    r"(?i)(?:,\s*|\s+)(?:and|but|or)\s*$",
    r"(?i)\s+(?:with|that|which|who|whom|whose|for|to|in|on|of|as|by|from|into|toward|towards|about|between|among|during|before|after)\s*$",
)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def passes(sentence: Column, low: Column | None = None) -> Column:
    """Whether a sentence is safe to learn from; ``low`` is it in lower case, where that is at hand. Screens are tried where a word of theirs stands."""
    return ~_any(F.lower(sentence) if low is None else low, STEMS) | (~F.regexp_replace(sentence, ASIDE, ",").rlike(NEGATED) & ~sentence.rlike(UNSAFE))


def canonical(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"(?i)^(?:the|a|an)\s+", "")


def names_something(name: Column) -> Column:
    """Whether a name begins with a capital and is neither a piece of a sentence nor a bare noun."""
    low = F.lower(F.trim(name))
    bare = low.isin(*GENERIC) | low.rlike(rf"^(?:the|a|an)\s+(?:{'|'.join(GENERIC)})$")
    return name.rlike(r"^\p{Lu}") & ~F.try_element_at(F.split(low, r"\s+"), F.lit(1)).isin(*STARTERS) & ~name.rlike(PIECE) & ~bare


def unhung(text: Column) -> Column:
    """A text without what hangs at its end; a word at least goes in each round, so there are as many rounds as words, none where nothing hangs."""
    hangs = F.trim(text).rlike("|".join(HANGING))
    cut = F.aggregate(F.split(text, r"\s+"), F.trim(text), lambda t, _: reduce(lambda x, p: F.trim(F.regexp_replace(x, p, "")), HANGING, t))
    return F.when(hangs, cut).otherwise(F.trim(text))


def _clause(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(raw), r"\s+in\s+\d{4}\s*$", ""), r"[.,; ]+$", "")


def persons(raw: Column) -> Column:
    """Names of two to four capital words in a clause."""
    return F.filter(F.regexp_extract_all(_clause(raw), F.lit(PERSON), F.lit(0)), lambda n: n.rlike(r"\s"))


def entities(raw: Column) -> Column:
    """Capital names in a clause that aren't possessives."""
    found = F.transform(F.regexp_extract_all(F.regexp_replace(_clause(raw), r"(?i)^(?:the|a|an)\s+", ""), F.lit(ENTITY), F.lit(0)), lambda n: F.regexp_replace(n, r"^[ ,.;]+|[ ,.;]+$", ""))
    return F.filter(found, lambda n: ~n.rlike(r"'s?$") & ~F.lower(n).isin("", "the", "a", "an"))


def aliases(raw: Column) -> Column:
    """Other names in a clause that lists them, without places."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(raw), r"[.,; ]+$", ""), r"\s+in\s+[A-Z][A-Za-z ,]+?(?=\s+and\b|$)", "")
    parts = F.transform(F.split(F.regexp_replace(clean, r"(?i)^(?:the|a|an)\s+", ""), r"\s+and\s+|,\s*"), canonical)
    return F.filter(parts, lambda p: p.rlike("[A-Z0-9]"))


def _definition(raw: Column) -> Column:
    """The definition in a clause, as an array of one or none."""
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), DEFINITION_END, ""), "[ ,]+$", "")
    words = F.split(F.trim(F.lower(text)), r"\s+")
    plain = F.array_join(words, " ")
    loose = F.try_element_at(words, F.lit(1)).isin(*LOOSE_HEADS) & ~F.arrays_overlap(F.slice(words, 2, 1000), F.array(*map(F.lit, FIRM_HEADS)))
    empty = reduce(lambda a, p: a | F.contains(plain, F.lit(p)), EMPTY_PHRASES, plain.isin(*BROAD))
    return F.when((F.size(words) >= 2) & ~loose & ~empty, F.array(text)).otherwise(F.array().cast("array<string>"))


def _objects(kind: str, raw: Column) -> Column:
    whole = F.regexp_replace(F.trim(raw), ",+$", "")
    capital = whole.rlike(r"^\p{Lu}")
    good = {"capital": capital, "work": capital & ~F.lower(whole).contains("range of"), "name": names_something(whole)}.get(kind)
    if good is not None:
        return F.when(good, F.array(whole)).otherwise(F.array().cast("array<string>"))
    if kind == "platforms":
        return F.concat(F.when(raw.contains("on-premises"), F.array(F.lit("on-premises"))).otherwise(F.array().cast("array<string>")), entities(raw))
    return {"persons": persons, "entities": entities, "aliases": aliases, "definition": _definition}.get(kind, F.array)(raw if kind != "whole" else whole)


def _parted(k: int, regex: str):
    """A function of a match and its place that makes a row of them, the pattern's number and both groups."""
    return lambda m, at: F.struct(F.lit(k).alias("k"), at.alias("at"), m.alias("m"), canonical(F.regexp_extract(m, regex, 1)).alias("left"), F.regexp_extract(m, regex, 2).alias("right"))


def yielded(sentences: DataFrame) -> DataFrame:
    """(page, place, pattern_id, subject, predicate, object, risk, stability, sentence): the facts of sentences (page, title, place, sentence, lead).

    Of equal facts of a page the first stays, by sentence, pattern and place; a page defines a subject once. Definitions
    come from lead sentences only, near their beginning.
    """
    # a filter would be moved below the steps that it reads and repeat them once for each use, so conditions stand within what is exploded
    text, low = F.col("sentence"), F.col("low")
    none = F.array().cast("array<struct<k:int,at:int,m:string,left:string,right:string>>")
    matches = []
    for k, p in enumerate(PATTERNS):
        there = _any(low, tuple(p.word.split("|")))
        all_ = F.transform(F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)), _parted(k, p.regex))
        matches.append(F.when(there & F.col("lead") if p.names == "definition" else there, all_).otherwise(none))
    spaced = F.when(text.rlike(r"[\t\n\x0b\f\r]"), F.regexp_replace(text, r"\s", " ")).otherwise(text)
    rows = sentences.select("page", F.trim(F.translate("title", "_", " ")).alias("page_name"), "place", "sentence", "lead", F.lower(spaced).alias("low"))
    rows = rows.select("page", "page_name", "place", "sentence", F.explode(F.when(text.isNotNull() & passes(text, low), F.concat(*matches)).otherwise(none)).alias("x")).select("*", "x.*").drop("x")
    kinds = {n: [k for k, p in enumerate(PATTERNS) if p.names == n] for n in dict.fromkeys(p.names for p in PATTERNS)}
    objects = reduce(lambda w, kv: w.when(F.col("k").isin(*kv[1]), _objects(kv[0], F.col("right"))), kinds.items(), F)
    low = F.lower("left")
    stands = reduce(lambda a, m: a | F.contains(low, F.lit(m)), PAGE_MARKS, low.isin(*PAGE_WORDS))
    of = lambda s: F.col("k").isin(*(k for k, p in enumerate(PATTERNS) if p.subject == s))
    subject = F.when(of("page") | (of("or_page") & stands), F.col("page_name")).otherwise(F.col("left"))
    definition = F.col("k").isin(*kinds["definition"])
    # a single word of a longer title doesn't say which of its things it is; a definition stands at the beginning
    single = ~F.col("subject").rlike(r"\s") & canonical(F.col("page_name")).rlike(r"\s") & F.array_contains(F.split(F.lower(canonical(F.col("page_name"))), r"\s+"), F.lower("subject"))
    good = F.when(of("page"), F.col("subject").rlike(r"^\p{Lu}")).otherwise(names_something(F.col("subject"))) & (~definition | ((F.instr("sentence", F.col("m")) <= 11) & ~single))
    rows = rows.withColumn("subject", subject).withColumn("object", F.explode(F.when(good, objects).otherwise(F.array().cast("array<string>")))).where("object != ''")
    table = F.array(*(F.struct(*(F.lit(getattr(p, c)).alias(c) for c in ("id", "predicate", "risk", "stability", "inverse"))) for p in PATTERNS))
    rows = rows.withColumn("p", F.try_element_at(table, F.col("k") + 1))
    left, right = (F.when(F.col("p.inverse"), F.col(b)).otherwise(F.col(a)) for a, b in (("subject", "object"), ("object", "subject")))
    rows = rows.select("page", "place", "k", "at", F.col("p.id").alias("pattern_id"), F.when(definition, F.trim(left)).otherwise(unhung(left)).alias("subject"), F.col("p.predicate").alias("predicate"), F.when(definition, right).otherwise(unhung(right)).alias("object"), F.col("p.risk").alias("risk"), F.col("p.stability").alias("stability"), "sentence")
    same = ["page", F.lower("subject"), "predicate", F.when(F.col("predicate") != "is_a", F.lower("object"))]
    first = F.row_number().over(Window.partitionBy(*same).orderBy("place", "k", "at", "object"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "k", "at")


def across_pages(facts: DataFrame) -> DataFrame:
    """Facts of which no earlier page has the same: equal triples, or definitions of the same subject; each task sends on the first pages that it has only."""
    same = [F.lower("subject"), "predicate", F.when(F.col("predicate") != "is_a", F.lower("object"))]
    return facts.withColumn("_r", F.rank().over(Window.partitionBy(*same).orderBy("page"))).where("_r = 1").drop("_r")
