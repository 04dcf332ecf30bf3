"""Registered queries: relations extracted from statements about all line items, validated, and judged by the firewalls."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import extraction, firewall
from factloom.plans.inference import read
from factloom.plans.shared import query


def pick(expression: str, values) -> str:
    """SQL that takes one of the values by number."""
    return f"CASE {expression} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def name_of(key: str) -> str:
    """A capital name of letters for a number."""
    return f"translate(CAST({key} AS STRING), '0123456789', 'ABCDEFGHIJ')"


_FORMS = (
    "was founded by", "was founded in 1999 by", "founded", "is founded by", "is a private software company founded by", "was developed by", "develops", "was designed and manufactured in Berlin by",
    "is manufactured by", "manufactures", "designs, manufactures, and sells", "produces", "is a product of", "is a service of", "is a platform of", "is a wholly owned subsidiary of", ", a subsidiary of",
    "is owned by", "was acquired by", "is the parent company of", "is headquartered in", "is operated by", "operates", "was created by", "was published by", "is part of", "uses", "provides", "enables",
    "are used for", "works through", "is the president of", "served as chairman of", "leads", "is valued at $5 billion by", "had a valuation of 12.5 million, said", "is a global energy company near",
    "holds the share price of", "currently is the owner that uses", "as all things are, uses", "can be used. This uses", "sits beside",
)
#: A statement about each line item: names made of its keys, one of many verbs, and beginnings that are no names.
STATEMENTS = f"""SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_linenumber % 3 AS sent,
 {pick('l_orderkey % 9', ["'Corp ' || a", "'In total, Corp ' || a", "'This corp'", "'corp ' || a", "a", "'Headquartered in New Town, Corp ' || a", "'The corp can'", "'Corp ' || a", "'Ann ' || a"])}
 || ' ' || {pick(f'(l_orderkey * 5 + l_linenumber * 7 + l_partkey) % {len(_FORMS)}', [f"'{f}'" for f in _FORMS])} || ' ' ||
 {pick('l_partkey % 7', ["'Item ' || b || ', and more'", "'devices'", "'Item ' || b || ' and its data'", "b || '.'", "'Ann ' || b || ' (x)'", "'Item ' || b", "'the'"])} || '.' AS sentence
 FROM (SELECT *, {name_of('l_suppkey')} AS a, {name_of('l_partkey')} AS b FROM lineitem) AS l"""
_QUOTED = lambda text: text.replace("'", "''")
_CLEAN = lambda x: f"trim(regexp_replace(regexp_replace(trim({x}), '[., ;:)]+$', ''), '{extraction.TRAILING}', ''))"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_GENERIC = lambda x: f"(length({x}) < 3 OR lower({x}) IN {_IN(extraction.BARE)} OR (len(regexp_split_to_array({x}, '\\s+')) > 1 AND (regexp_split_to_array(lower({x}), '\\s+')[1] IN {_IN(extraction.POINTING)} OR regexp_split_to_array(lower({x}), '\\s+')[-1] IN {_IN(extraction.AUXILIARY)})))"
_SCREENS = "concat_ws(';', " + ", ".join(f"CASE WHEN regexp_matches(sentence, '{_QUOTED(p)}') THEN '{n}' END" for n, p in extraction.SCREENS) + ")"
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, sent, sentence, {k} AS k, '{name}' AS pattern_id, '{relation}' AS relation, '{confidence}' AS confidence, '{stability}' AS stability, '{risk}' AS risk, unnest(regexp_extract_all(sentence, '{_QUOTED(regex)}', {first})) AS s, unnest(regexp_extract_all(sentence, '{_QUOTED(regex)}', {3 - first})) AS o, unnest(range(len(regexp_extract_all(sentence, '{_QUOTED(regex)}')))) AS place FROM st"
    for k, (name, relation, regex, first, confidence, stability, risk) in enumerate(extraction.PATTERNS)
)
_CANDIDATES = f"""WITH st AS ({STATEMENTS.replace('AS STRING', 'AS VARCHAR')}), f AS ({_FOUND}), c AS (SELECT *, {_CLEAN('s')} AS subject, {_CLEAN('o')} AS object FROM f),
 g AS (SELECT * FROM c WHERE subject != '' AND object != '' AND NOT {_GENERIC('subject')} AND NOT {_GENERIC('object')} AND len(regexp_split_to_array(subject, '\\s+')) <= 8 AND len(regexp_split_to_array(object, '\\s+')) <= 8 AND (relation != 'is_a' OR lower(subject) != lower(object))),
 d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(subject), relation, lower(object) ORDER BY sent, k, place, sentence) AS n, {_SCREENS} AS screens FROM g),
 cand AS (SELECT doc_id, sent, pattern_id, subject, relation, object, CASE WHEN screens != '' THEN 'low' ELSE confidence END AS confidence, stability, risk, screens, sentence FROM d WHERE n = 1) """


def _statements(spark, sf_dir):
    return read(spark, sf_dir, STATEMENTS)


@query(_CANDIDATES + "SELECT * FROM cand")
def relation_candidates(spark, sf_dir):
    return extraction.candidates(_statements(spark, sf_dir))


SURFACES = f"""SELECT lower('Corp ' || {name_of('s_suppkey')}) AS surface, 'Corp ' || {name_of('s_suppkey')} || ' Ltd' AS canonical, CASE WHEN s_suppkey % 9 = 0 THEN 'person' ELSE 'organization' END AS type FROM supplier
 UNION ALL SELECT lower('Item ' || {name_of('p_partkey')}), 'Item ' || {name_of('p_partkey')}, 'product' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT lower('Ann ' || {name_of('p_partkey')}), 'Ann ' || {name_of('p_partkey')}, 'person' FROM part"""
EXISTING = f"""SELECT 'corp ' || {name_of('s_suppkey')} || ' ltd' AS subject, 'manufactures' AS predicate, 'item' AS object FROM supplier UNION ALL SELECT 'Item', 'parent_company_of', 'Corp ' || {name_of('s_suppkey')} || ' Ltd' FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT 'item', 'founded', 'Corp ' || {name_of('s_suppkey')} || ' Ltd' FROM supplier"""
_WEAK = lambda x, known: f"(length({x}) < 2 OR len(regexp_split_to_array({x}, '\\s+')) > 7 OR (len(regexp_split_to_array({x}, '\\s+')) = 1 AND (lower(regexp_replace({x}, '[.,;:)]+$', '')) IN {_IN(extraction.NO_NAMES)} OR (NOT regexp_matches({x}, '^[A-Z]') AND NOT {known}) OR (regexp_matches({x}, '^[A-Z][A-Za-z]*$') AND NOT {known}))))"
_PLAIN = lambda x, known, most: f"({known} OR (regexp_matches({x}, '^[A-Z]') AND NOT regexp_matches({x}, '[0-9,]') AND len(regexp_split_to_array({x}, '\\s+')) <= {most}))"
_TRIPLE = "(lower(v.{0}), {1}, lower(v.{2})) IN (SELECT lower(subject), predicate, lower(object) FROM ex)"
_SAME = "CASE v.relation WHEN 'manufactures' THEN 'produces' WHEN 'produces' THEN 'manufactures' WHEN 'is_a' THEN 'type_of' WHEN 'type_of' THEN 'is_a' ELSE v.relation END"
_TWIN = "CASE v.relation WHEN 'founded_by' THEN 'founded' WHEN 'founded' THEN 'founded_by' END"
_OPPOSITE = "CASE v.relation WHEN 'owned_by' THEN 'owns' WHEN 'subsidiary_of' THEN 'parent_company_of' WHEN 'parent_company_of' THEN 'subsidiary_of' END"


@query(_CANDIDATES + f""", su AS ({SURFACES.replace('AS STRING', 'AS VARCHAR')}), ex AS ({EXISTING.replace('AS STRING', 'AS VARCHAR')}),
 r AS (SELECT cand.* REPLACE (coalesce(a.canonical, cand.subject) AS subject, coalesce(b.canonical, cand.object) AS object), a.surface IS NOT NULL AS ks, b.surface IS NOT NULL AS ko, coalesce(a.type, '') AS ts, coalesce(b.type, '') AS ot FROM cand LEFT JOIN su a ON a.surface = lower(cand.subject) LEFT JOIN su b ON b.surface = lower(cand.object)),
 w AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN relation IN {_IN(extraction.ORGANIZATION_SUBJECT)} AND ts = 'person' THEN 'directionality_conflict' END, CASE WHEN (relation IN {_IN(extraction.NO_PERSON_SUBJECT)} AND ts = 'person') OR (relation IN {_IN(extraction.NO_PERSON_OBJECT)} AND ot = 'person') THEN 'entity_type_conflict' END,
  CASE WHEN NOT ks AND NOT ko AND confidence = 'low' THEN 'generic_entity_match' END, CASE WHEN {_WEAK('subject', 'ks')} OR {_WEAK('object', 'ko')} OR NOT {_PLAIN('subject', 'ks', 5)} OR NOT {_PLAIN('object', 'ko', 6)} OR regexp_matches(subject, '{extraction.FRAGMENT}') THEN 'missing_explicit_evidence' END] || string_split(screens, ';'), lambda x: x IS NOT NULL AND x != ''))) AS l FROM r),
 v AS (SELECT *, CASE WHEN len(l) = 0 AND confidence = 'low' THEN ['low_confidence'] ELSE l END AS reason FROM w)
 SELECT doc_id, sent, pattern_id, subject, relation, object, confidence, CASE WHEN {_TRIPLE.format('subject', 'v.relation', 'object')} OR {_TRIPLE.format('subject', _SAME, 'object')} OR coalesce({_TRIPLE.format('object', _TWIN, 'subject')}, false) THEN 'duplicate' WHEN coalesce({_TRIPLE.format('object', _OPPOSITE, 'subject')}, false) THEN 'conflict' WHEN len(reason) > 0 THEN 'quarantine' ELSE 'safe' END AS verdict, array_to_string(reason, ';') AS reasons FROM v""")  # fmt: skip
def candidate_validation(spark, sf_dir):
    return extraction.validated(extraction.candidates(_statements(spark, sf_dir)), read(spark, sf_dir, SURFACES), read(spark, sf_dir, EXISTING))


NODES = f"""SELECT l_orderkey * 10 + l_linenumber AS id, {pick('l_orderkey % 6', ["'we'", "'Corp ' || a", "'our method'", "'training Corp'", "'security system'", "'SkyServer System'"])} AS subject,
 {pick('l_partkey % 5', ["'methods'", "'Item ' || b", "'a way to achieve'", "'item ' || b", "'data'"])} AS object,
 {pick('l_linenumber % 3', ["'They list: x, Item ' || b || ', data'", "'Note: Item ' || b", "'Corp ' || a || ' uses Item ' || b"])} AS sentence, l_suppkey % 2 = 0 AS subject_known, l_partkey % 3 = 0 AS object_known
 FROM (SELECT *, {name_of('l_suppkey')} AS a, {name_of('l_partkey')} AS b FROM lineitem) AS l"""


def _node_sql(x: str, known: str) -> str:
    after = "CASE WHEN instr(sentence, ':') > 0 THEN substr(sentence, instr(sentence, ':') + 1) ELSE '' END"
    return f"""CASE WHEN regexp_matches({x}, '{extraction.DEEDS}') THEN 'event_like_node' END, CASE WHEN regexp_extract(lower({x}), '([a-z][a-z-]*)[^a-z]*$', 1) IN {_IN(extraction.GENERIC_HEADS)} AND NOT regexp_matches({x}, '\\s[A-Z]') THEN 'generic_abstract_node' END,
 CASE WHEN contains({after}, ',') AND contains(lower({after}), lower({x})) THEN 'list_derived_context' END, CASE WHEN NOT {known} THEN 'unresolvable_entity' END"""


@query(f"WITH n AS ({NODES.replace('AS STRING', 'AS VARCHAR')}) SELECT id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN regexp_matches(subject, '{extraction.AUTHORS}') THEN 'authorial_self_reference' END, {_node_sql('subject', 'subject_known')}, {_node_sql('object', 'object_known')}], lambda x: x IS NOT NULL))), ';') AS reasons FROM n")
def node_quality(spark, sf_dir):
    reasons = extraction.node_reasons(F.col("subject"), F.col("object"), F.col("sentence"), F.col("subject_known"), F.col("object_known"))
    return read(spark, sf_dir, NODES).select("id", F.array_join(reasons, ";").alias("reasons"))


# --- firewalls ---

_PREDICATES = (
    "known_for", "subsidiary_of", "owned_by", "develops", "developed_by", "produces", "publishes", "published_by", "founded", "founded_by", "ceased_operations", "has_facility", "is_a", "uses", "headquartered_in",
    "leader_of", "part_of",
)
#: An item about each line item: names and evidence of many shapes, made of its keys.
ITEMS = f"""SELECT id, kind, subject, predicate, object,
 {pick('e', ["subject || ' is known for and owned by ' || object || ' in Town'", "'It was never developed, ' || object", "subject || ' was acquired by ' || object || ' and headquartered in Rome'", "'Nothing of note'", "subject || ' is a ' || object || ' of note'", "'Also ' || subject || ' is the ' || object", "'Operated by ' || subject || ', owned by ' || object"])} AS evidence,
 {pick('g', ["subject || ' University'", "'Max ' || subject", "subject", "''"])} AS source_page, {pick('g', ["''", "'arxiv_v1'", "'arxiv_v1'", "'other'"])} AS extraction, CASE WHEN g < 2 THEN 'arxiv' ELSE 'crossref' END AS source_kind
 FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 1 THEN 'definition' ELSE 'relation' END AS kind, l_suppkey % 7 AS e, (l_orderkey + l_partkey) % 4 AS g,
 {pick('l_orderkey % 14', ["'Corp ' || a", "'Corp ' || a", "'Levchin'", "'if many corps'", "'United States'", "'Founding Corp ' || a", "'Corp ' || a || ', also known as X'", "'Corp ' || a || ', and'", "'Dragon Capsule ' || a", "'technology'", "'Press Society'", "'London'", "a || ' of the ' || a", "'corp ' || a"])} AS subject,
 {pick(f'(l_orderkey + l_linenumber * 5 + l_suppkey) % {len(_PREDICATES)}', [f"'{p}'" for p in _PREDICATES])} AS predicate,
 {pick('l_partkey % 19', ["'Item ' || b", "'Item ' || b", "'american'", "'January'", "'1999'", "'which item'", "'mission patch'", "'HP'", "'Hewlett-Packard'", "'Roger Mc'", "'stock exchange'", "'all items'", "'London'", "'wide range of Items'", "'american item'", "'item (x'", "'machine learning'", "'award winner'", "'item designed'"])} AS object
 FROM (SELECT *, {name_of('l_suppkey % 20')} AS a, {name_of('l_partkey % 30')} AS b FROM lineitem) AS l) AS i"""


def _items(spark, sf_dir):
    return read(spark, sf_dir, ITEMS)


def _firewall_sql() -> str:
    w = firewall

    key = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    words = lambda x: f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda t: t != '')"
    bare = lambda x: f"regexp_replace(lower({x}), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')"
    some = lambda x, phrases: "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"
    capital = lambda x: f"len(list_filter({words(x)}, lambda t: {bare('t')} != '' AND NOT list_contains([{', '.join(repr(f) for f in w.FUNCTION_WORDS)}], {bare('t')}) AND NOT regexp_matches(t, '^[A-Z0-9]') AND NOT (regexp_matches(t, '[A-Z]') AND t = upper(t)))) = 0"
    holds = lambda x, bad: f"len(list_filter({words(x)}, lambda t: list_contains([{', '.join(repr(f) for f in bad)}], {bare('t')}))) > 0"
    lead = lambda x, leads: f"coalesce({bare(f'{words(x)}[1]')} IN {_IN(leads)}, false)"
    subject_ok = f"(len({words('subject')}) > 0 AND {key('subject')} NOT IN {_IN(w.GENERIC_SUBJECTS)} AND len({words('subject')}) <= 7 AND NOT {lead('subject', w.FRAGMENT_LEADS)} AND NOT {holds('subject', (*w.FRAGMENT_MARKERS, *w.CLAUSE_VERBS))} AND {capital('subject')})"
    entity = f"(len({words('object')}) > 0 AND {key('object')} NOT IN {_IN(w.GENERIC_OBJECTS)} AND len({words('object')}) <= 6 AND NOT {lead('object', w.OBJECT_LEADS)} AND NOT {holds('object', w.CLAUSE_VERBS)} AND {capital('object')})"
    clause = some("' ' || " + key("object") + " || ' '", w.OBJECT_CLAUSES)
    phrase = f"(len({words('object')}) > 0 AND {key('object')} NOT IN {_IN(w.GENERIC_OBJECTS)} AND NOT regexp_matches(object, '[()]') AND NOT regexp_matches(object, '(?:19|20)[0-9]{{2}}') AND len({words('object')}) <= 6 AND NOT {lead('object', w.OBJECT_LEADS)} AND NOT {clause})"
    named = f"len(list_filter({words('object')}, lambda t: NOT list_contains([{', '.join(repr(f) for f in w.FUNCTION_WORDS)}], {bare('t')}) AND regexp_matches(t, '^[A-Z]') AND t != upper(t))) > 0"
    cut_end = " OR ".join(f"ends_with(lower(trim(object)), '{x}')" for x in w.CUT_ENDINGS)
    case = lambda *steps: "CASE " + " ".join(f"WHEN {c} THEN '{v}:{r}'" for c, v, r in steps) + " ELSE 'accept:' END"
    relation = f"""CASE WHEN p NOT IN {_IN(w.EVENTS)} AND ({key('object')} IN {_IN(w.MONTHS)} OR regexp_matches({key('object')}, '^([0-9]{{4}}|[0-9]{{1,3}})$')) THEN 'reject:object_is_temporal_word'
     WHEN p = 'known_for' THEN CASE WHEN NOT sok THEN 'reject:known_for_bad_subject' WHEN {some('told', ('known for', 'best known', 'famous for'))} AND ent AND nw <= 3 THEN 'accept:' ELSE 'quarantine:known_for_default_quarantine' END
     WHEN p = 'subsidiary_of' THEN {case(('NOT sok', 'reject', 'subsidiary_bad_subject'), ('NOT ent', 'reject', 'subsidiary_bad_object'), (f"NOT contains(told, {key('subject')})", 'reject', 'subsidiary_subject_not_in_evidence'), ('absent', 'reject', 'subsidiary_object_not_in_evidence'))}
     WHEN p = 'owned_by' THEN {case(('NOT sok', 'reject', 'owned_by_bad_subject'), ('NOT ent', 'reject', 'owned_by_bad_object'), (f"NOT {some('told', w.OWNERSHIP)}", 'reject', 'owned_by_no_ownership_evidence'), ('absent', 'reject', 'owned_by_object_not_in_evidence'), (f"contains(told, 'by ' || {key('subject')})", 'reject', 'owned_by_subject_is_agent'))}
     WHEN p IN ('develops', 'developed_by') THEN {case((some('told', w.NEGATIONS), 'reject', 'develops_negated'), ('NOT sok', 'reject', 'develops_bad_subject'), ("p = 'developed_by' AND NOT ent", 'reject', 'developed_by_bad_object'), ("p != 'developed_by' AND NOT phr", 'reject', 'develops_bad_object'), ('absent', 'reject', 'develops_object_not_in_evidence'))}
     WHEN p = 'produces' THEN {case(('NOT sok', 'reject', 'produces_bad_subject'), ('NOT phr', 'reject', 'produces_bad_object'), ('absent', 'reject', 'produces_object_not_in_evidence'))}
     WHEN p = 'publishes' THEN {case(('NOT sok', 'reject', 'publishes_bad_subject'), ('NOT phr', 'reject', 'publishes_bad_object'), (f"contains({key('object')}, 'range of')", 'quarantine', 'publishes_vague_object'), (f'NOT ({named})', 'quarantine', 'publishes_unnamed_publication'), ('absent', 'reject', 'publishes_object_not_in_evidence'))}
     WHEN p IN ('founded', 'founded_by') THEN {case(('NOT sok', 'reject', 'founded_bad_subject'), ('NOT ent', 'reject', 'founded_bad_object'), ('absent', 'reject', 'founded_object_not_in_evidence'))}
     WHEN p = 'is_a' THEN {case(('NOT sok', 'reject', 'is_a_bad_subject'), (f"{key('object')} IN {_IN(w.BROAD_CLASSES)}", 'reject', 'is_a_object_too_broad'), (f"nw >= 2 AND string_split({key('object')}, ' ')[1] IN {_IN(w.NATIONALITIES)}", 'reject', 'is_a_object_truncated_nationality'), ('NOT phr', 'quarantine', 'truncated_is_a_object'))}
     WHEN p IN {_IN(w.EVENTS)} THEN {case(('NOT sok', 'reject', 'event_relation_bad_subject'), ("object = '' OR nw > 5", 'reject', 'event_relation_bad_object'), ('absent', 'reject', 'event_relation_object_not_in_evidence'))}
     WHEN p IN {_IN(w.CONCEPTS)} THEN {case((f"NOT regexp_matches(subject, '^[A-Z]') OR len({words('subject')}) > 6", 'reject', 'concept_relation_bad_subject'), ('NOT phr', 'reject', 'concept_relation_bad_object'), ('absent', 'reject', 'concept_relation_object_not_in_evidence'))}
     ELSE {case(('NOT sok', 'reject', 'generic_relation_bad_subject'), ('NOT (ent OR phr)', 'reject', 'generic_relation_bad_object'), ('absent', 'reject', 'generic_relation_object_not_in_evidence'))} END"""
    d = key("object")
    after = f"regexp_replace(string_split(' ' || told, ' ' || {key('subject')})[-1], '^\\s*(?:\\([^)]*\\))?(?:,\\s+also\\s+known\\s+as\\s+[^,]{{1,60}},)?\\s+(?:is|was|are|were)\\s+', '=')"
    three = f"array_to_string(string_split({d}, ' ')[1:3], ' ')"
    led = f"(starts_with({after}, '=') AND contains(' ' || told, ' ' || {key('subject')}) AND (starts_with(regexp_replace({after}, '^=(?:a |an |the )?', ''), {three}) OR starts_with(regexp_replace({after}, '^=', ''), {three})))"
    definition = case(
        (f"contains(told, 'birthstone') AND {d} IN {_IN(w.GEMS)} AND contains(told, {d})", "property_candidate", "definition_birthstone"),
        ("contains(told, 'birthstone')", "quarantine", "property_candidate_not_answerable_definition"),
        (f"{key('subject')} IN {_IN(w.GENERIC_SUBJECTS)}", "reject", "generic_definition_subject"),
        (f"{some(d, w.BAD_DEFINITIONS)} OR string_split({d}, ' ')[1] IN {_IN(w.BAD_LEADS)} OR string_split(told, ' ')[1] IN {_IN(w.BAD_LEADS)}", "reject", "definition_not_lead_style"),
        ("length(regexp_replace(object, '[^(]', '', 'g')) != length(regexp_replace(object, '[^)]', '', 'g'))", "reject", "truncated_definition"),
        (f"{d} = '' OR NOT {led}", "reject", "definition_not_lead_style"),
    )
    checked = "('headquartered_in', 'owned_by', 'acquired_by', 'develops', 'developed_by', 'founded_by', 'publishes', 'produces')"
    comma = "ends_with(trim(subject), ',') OR contains(trim(subject), ', and ')"
    relation2 = case(
        (f"p IN {_IN(w.VOLATILE)}", "quarantine", "volatile_predicate"),
        (comma, "reject", "dangling_comma_subject"),
        (f"regexp_matches(subject, '{w.APPOSITION}')", "reject", "appositive_alias_subject"),
        (" OR ".join(f"starts_with(lower(trim(subject)), '{x}')" for x in w.SUBJECT_LEADS), "reject", "fragment_prefix_subject"),
        (f"p IN {_IN(w.CORPORATE)} AND {key('subject')} IN {_IN(w.PLACES)}", "reject", "geopolitical_subject_corporate_predicate"),
        ("p = 'headquartered_in' AND NOT contains(told, 'headquartered in') AND NOT contains(told, 'headquarters in')", "quarantine", "headquarters_subject_or_clause_uncertain"),
        (f"p IN ('owned_by', 'acquired_by') AND {key('object')} IN {_IN(w.STATES)}", "reject", "owned_by_geopolitical_object"),
        (f"p = 'developed_by' AND {key('object')} IN {_IN(w.TOWNS)}", "reject", "developed_by_location_object"),
        (f"p = 'develops' AND {key('subject')} IN {_IN(w.TOWNS)}", "reject", "develops_location_subject"),
        (f"p IN ('develops', 'developed_by') AND regexp_matches(object, '{w.ARTIFACTS}')", "reject", "develops_design_artifact_object"),
        (f"p = 'founded_by' AND regexp_matches(trim(object), '{w.CUT_NAME}')", "reject", "founded_by_truncated_object"),
        (f"p = 'founded_by' AND {key('object')} IN {_IN(w.GENERIC_ENTITIES)}", "reject", "founded_by_generic_object"),
        (f"p = 'publishes' AND regexp_matches(trim(subject), '{w.PUBLISHER_PHRASE}')", "reject", "publishes_phrase_subject"),
        (f"p = 'produces' AND regexp_matches(object, '{w.UNIVERSAL}')", "reject", "produces_universal_object"),
        (f"p NOT IN {checked} AND nw > 5 AND regexp_matches(trim(object), '{_QUOTED(w.LONG_TAIL)}')", "quarantine", "object_has_descriptive_tail"),
    )
    noun = f"regexp_extract({d}, '{w.NATIONALITY_NOUN}', 1)"
    definition2 = case(
        (f"regexp_matches(subject, '{w.APPOSITION}')", "reject", "appositive_alias_subject"),
        (comma, "reject", "dangling_comma_subject"),
        (f"{cut_end} OR regexp_matches(trim(object), '\\bthe\\s+[Uu]\\.?\\s*$') OR (nw <= 6 AND coalesce(lower({words('object')}[-1]) IN {_IN(w.SHORT_ENDS)}, false))", "reject", "truncated_definition"),
        (f"{noun} != '' AND {noun} NOT IN {_IN(w.ROLES)}", "reject", "definition_nationality_plus_single_noun"),
    )
    short = " OR ".join(f"starts_with({key('source_page')}, {key('subject')} || '{x}')" for x in w.INSTITUTIONS)
    vehicle = "len(list_filter(" + words("lower(subject)") + f", lambda t: list_contains([{', '.join(repr(v) for v in w.VEHICLES)}], t))) > 0"
    relation3 = case(
        ("p = 'headquartered_in'", "quarantine", "headquartered_in_quarantine_default"),
        (f"p = 'owned_by' AND {vehicle}", "quarantine", "owned_by_predicate_ambiguous"),
        ("same > 1 AND ko != canon", "quarantine", "duplicate_alias_relation"),
        (f"p IN ('founded_by', 'founded', 'developed_by', 'develops') AND ks != '' AND ({short})", "quarantine", "subject_alias_too_short"),
        ("p IN ('founded_by', 'developed_by') AND regexp_matches(trim(object), '^[A-Z][^A-Z \t]{2,}$')", "quarantine", "truncated_person_alias"),
        (f"p = 'develops' AND regexp_matches(trim(subject), '^[A-Z][^A-Z \t]{{2,}}$') AND len({words('source_page')}) >= 2 AND lower({words('source_page')}[-1]) = lower(trim(subject))", "quarantine", "truncated_person_alias"),
    )
    end = words("regexp_replace(trim(object), '[.,; ]+$', '')")
    participle = f"coalesce(lower({end}[-1]) IN {_IN(w.PARTICIPLES)}, false)"
    definition3 = case((participle, "reject", "definition_truncated_participle"))
    return f"""WITH i AS ({ITEMS.replace('AS STRING', 'AS VARCHAR')}),
    k AS (SELECT *, {key('predicate')} AS p, {key('subject')} AS ks, {key('object')} AS ko, CASE {key('object')} {' '.join(f"WHEN '{a}' THEN '{c}'" for a, c in w.ALIASES.items())} ELSE {key('object')} END AS canon, {key('evidence')} AS told, {subject_ok} AS sok, {entity} AS ent, {phrase} AS phr, len({words('object')}) AS nw, NOT contains({key('evidence')}, {key('object')}) AS absent FROM i),
    g AS (SELECT *, CASE WHEN kind = 'relation' THEN {relation} ELSE {definition} END AS one, CASE WHEN kind = 'relation' THEN {relation2} ELSE {definition2} END AS two FROM k),
    s AS (SELECT *, count(*) FILTER (kind = 'relation' AND one = 'accept:' AND two = 'accept:') OVER (PARTITION BY ks, p, canon) AS same FROM g),
    f AS (SELECT *, CASE WHEN kind = 'relation' THEN {relation3} ELSE {definition3} END AS three FROM s),
    r AS (SELECT *, CASE WHEN one != 'accept:' THEN one WHEN two != 'accept:' THEN two ELSE three END AS last FROM f)
    SELECT id, kind, predicate, (CASE WHEN one != 'accept:' THEN 1 WHEN two != 'accept:' THEN 2 ELSE 3 END)::INT AS gate, split_part(last, ':', 1) AS verdict, split_part(last, ':', 2) AS reason FROM r"""


@query(_firewall_sql())
def firewall_verdicts(spark, sf_dir):
    return firewall.judged(_items(spark, sf_dir)).select("id", "kind", "predicate", "gate", "verdict", "reason")


@query(f"""WITH i AS ({ITEMS.replace('AS STRING', 'AS VARCHAR')}), k AS (SELECT *, lower(trim(subject)) AS ks, lower(trim(source_page)) AS kp, lower(trim(regexp_extract(evidence, '{firewall.LEAD}', 1))) AS lead FROM i),
 v AS (SELECT id, CASE WHEN kind = 'relation' THEN CASE WHEN extraction != '' AND starts_with(extraction, source_kind || '_') THEN 'accept:' ELSE 'quarantine:open_web_relation_requires_source_specific_extractor' END WHEN ks = '' OR ks != kp THEN 'reject:open_web_subject_not_source_title' WHEN lead = '' OR lead != ks THEN 'reject:open_web_not_direct_title_led_definition'
 WHEN len(list_filter(string_split(lower(trim(object)), ' '), lambda t: list_contains([{', '.join(repr(t) for t in firewall.EVALUATIVE)}], t))) > 0 THEN 'reject:open_web_evaluative_or_temporal_definition' ELSE 'accept:' END AS v FROM k) SELECT id, split_part(v, ':', 1) AS verdict, split_part(v, ':', 2) AS reason FROM v""")  # fmt: skip
def open_source_gate(spark, sf_dir):
    return _items(spark, sf_dir).select("id", firewall.source_verdict().alias("v")).select("id", F.substring_index("v", ":", 1).alias("verdict"), F.substring_index("v", ":", -1).alias("reason"))
