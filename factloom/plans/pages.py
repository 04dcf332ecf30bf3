"""Registered queries: facts and definitions from pages of text that are derived from orders and their line items."""

from __future__ import annotations

from functools import reduce

from factloom.operators import pages, yields
from factloom.plans.extracted import name_of, pick
from factloom.plans.inference import read
from factloom.plans.shared import query

_FORMS = (
    "{a} Inc. was founded in 1999 by serial investor Ann {b} and Bob {c} in 1999.", "{a} is a wholly owned subsidiary of Group {b}.", "{a} is a small division of Group {b}, near town.",
    "{a} publishes news including the weekly Times {b}.", "{a} publishes the Daily {b}.", "{a} publishes a Range of {b}.", "The {a} engine was developed by the firm Works {b} in 2001.",
    "{a} was acquired by Group {b} in 2010.", "{a} was manufactured by Works {b} and Mill {c}.", "{a} was owned by the Trust {b}.", "{a} was operated by Rail {b} in 1950.", "{a} acquired Group {b} in 2011.",
    "{a} is headquartered in New {b}.", "{a}, also known as Big {b} and Old {c}, is here.", "{a} was marketed as the Super {b}.", "{a} was funded by Fund {b} with grants.", "{a} is a plant in Port {b}.",
    "{a} was a crew based at the Camp {b}.", "{a} was introduced in 1987.", "It was first released in 1990.", "Construction began in May 1991.", "{a} ceased operations in 2004.",
    "{a} filed for Chapter 11 bankruptcy.", "It merged that year with Works {b} to form Union {c}.", "{a} supports many formats, including all of them.", "{a} provides tools that help, using devices.",
    "{a} uses cold water to cool.", "{a} enables quick work by hand; more.", "It is used for storage and.", "{a} works by pressure from the.", "It runs on on-premises and Cloud {b}.",
    "{a} is also offered on Store {b}.", "{a} flew 12 cargo missions to the Base {b} between years.", "A small airport is large with customs and border control facilities.", "{a} is not a firm in Port {b}.",
    "{a} is a lamp, not designed to burn, in Port {b}.", "{a} currently uses Port {b}.", "{a} was introduced in 2024.", "He said so. Dr. {a} uses the U.S. Army map. It ended there.", "In total, {a} uses coal.",
    "The company provides gas.", "The former {a} uses oil.", "All systems are safe and {a} uses them.",
)
_LEADS = (
    "{t} (born 1950), also known as X, is an American engineer best known for {b}.", "{t} is a British thing of note.", "{t} is one of the oldest works in the area.", "{t} was the largest mill, which ran for years.",
    "{t} are a group of works in production, all of them large, and old.", "In the history of {t}, the age lasted approximately from 1200 to 1300, as is known.", "Present-day {t} includes both the old town and the new one.",
    "{t} (also (old). \"{b}\" was a company that made {b}.", "The name is short. {t} is the same. Later {t} was a river of the.", "{t} is a {t} of many.", "{t} is a place of 2024 fame.", "The third {t} is any {b} that serves with.",
    "{t} is an award winner of the year.", "{t} election is a series of debates.",
)


def _filled(form: str, **names: str) -> str:
    """SQL of a form with the names put in."""
    text = "'" + form.replace("'", "''") + "'"
    for k, v in names.items():
        text = text.replace("{" + k + "}", f"' || {v} || '")
    return text


_SENTENCES = f"""SELECT l_orderkey, l_linenumber, {pick(f'(l_orderkey * 3 + l_linenumber * 11 + l_partkey) % {len(_FORMS)}', [_filled(f, a="a", b="b", c="c") for f in _FORMS])}
 || CASE WHEN l_linenumber % 3 = 0 THEN chr(10) || chr(10) || '## Part ' || l_linenumber || chr(10) WHEN l_linenumber % 3 = 1 THEN chr(10) ELSE ' ' END AS sentence
 FROM (SELECT *, {name_of('l_suppkey')} AS a, lower({name_of('l_partkey')}) AS d, upper(substr({name_of('l_partkey')}, 1, 1)) || lower(substr({name_of('l_partkey')}, 2)) || 'en' AS b, 'Z' || lower({name_of('l_suppkey')}) AS c FROM lineitem) AS l"""
#: A page for each order: title, metadata, a lead, a sentence for each line item, headings and paragraphs.
PAGES = f"""SELECT o_orderkey AS page, '# ' || t || chr(10) || 'Source: orders' || chr(10) || 'Last-Seen: 2020' || chr(10) || chr(10) ||
 {pick(f'o_orderkey % {len(_LEADS)}', [_filled(f, t="t", b="b") for f in _LEADS])} || CASE WHEN o_custkey % 2 = 0 THEN ' ' ELSE chr(10) || chr(10) END || coalesce(lines, '') AS text
 FROM (SELECT *, 'Order ' || {name_of('o_custkey')} AS t, 'Line ' || {name_of('o_orderkey')} AS b FROM orders) AS o LEFT JOIN (SELECT l_orderkey, LINES AS lines FROM ({_SENTENCES}) AS s GROUP BY l_orderkey) AS x ON l_orderkey = o_orderkey"""
_SPARK = PAGES.replace("LINES", "listagg(sentence, '') WITHIN GROUP (ORDER BY l_linenumber, sentence)")
_DUCK = PAGES.replace("LINES", "string_agg(sentence, '' ORDER BY l_linenumber, sentence)").replace("AS STRING", "AS VARCHAR")


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _regex(pattern: str) -> str:
    """A pattern without lookahead: what must follow is taken with the match."""
    return _quoted(pattern.replace("(?=", "(?:"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{_quoted(w)}'" for w in words) + "]"


def _replace(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, '{_quoted(pattern)}', {by}, 'g')"


_WORDS = lambda x: f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w != '')"
_BODY = "trim(regexp_replace(coalesce(text, ''), '\\A(?:[ \\t]*(?:# [^\\n]*|" + r"[A-Za-z][A-Za-z0-9 /-]+:[^\n]*" + ")?[ \\t]*(?:\\n|\\z))*', ''))"
_PARAGRAPHS = f"list_filter(list_transform(regexp_split_to_array({_replace(_BODY, '(?m)^[ ' + chr(92) + 't]*#.*$')}, '\\n(?:[ \\t]*\\n)+'), lambda p: trim(regexp_replace(p, '[ \\t]*\\n[ \\t]*', ' ', 'g'))), lambda p: p != '')"
_SPLIT = lambda p: (
    f"list_filter(list_transform(string_split(regexp_replace({_replace(p, rf'(?i)\b({pages.ABBREVIATIONS})\.', chr(39) + chr(92) + '1' + chr(39) + ' || chr(1)')}, '([.!?])\\s+([A-Z\"])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: length(s) >= {pages.LEAST_SENTENCE})"
)
_TITLE = "trim(regexp_extract(text, '(?m)^[ \\t]*# (.*)$', 1))"
_NAMED = lambda x: (
    f"(regexp_matches({x}, '^\\p{{Lu}}') AND NOT list_contains({_list(yields.STARTERS)}, regexp_split_to_array(lower(trim({x})), '\\s+')[1]) AND NOT regexp_matches({x}, '{yields.PIECE}')"
    f" AND NOT list_contains({_list(yields.GENERIC)}, lower(trim({x}))) AND NOT regexp_matches(lower(trim({x})), '^(?:the|a|an)\\s+(?:{'|'.join(yields.GENERIC)})$'))"
)
_CANON = lambda x: f"regexp_replace(trim({x}), '(?i)^(?:the|a|an)\\s+', '')"
_CLAUSE = lambda x: f"regexp_replace(regexp_replace(trim({x}), '\\s+in\\s+\\d{{4}}\\s*$', ''), '[.,; ]+$', '')"
_ENTITIES = f"list_filter(list_transform(regexp_extract_all({_CANON(_CLAUSE('r'))}, '{_quoted(yields.ENTITY)}'), lambda n: regexp_replace(n, '^[ ,.;]+|[ ,.;]+$', '', 'g')), lambda n: NOT regexp_matches(n, '''s?$') AND lower(n) NOT IN ('', 'the', 'a', 'an'))"
_ALIASES = f"list_filter(list_transform(regexp_split_to_array({_CANON('regexp_replace(regexp_replace(trim(r), ' + chr(39) + '[.,; ]+$' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + chr(92) + 's+in' + chr(92) + 's+[A-Z][A-Za-z ,]+?(' + chr(92) + 's+and' + chr(92) + 'b|$)' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\\s+and\\s+|,\\s*'), lambda p: {_CANON('p')}), lambda p: regexp_matches(p, '[A-Z0-9]'))"
_CUT = f"regexp_replace(regexp_replace(trim(r), '{yields.DEFINITION_END}', ''), '[ ,]+$', '')"
_DEFINITION = (
    f"CASE WHEN len({_WORDS(_CUT)}) >= 2 AND array_to_string({_WORDS('lower(' + _CUT + ')')}, ' ') NOT IN ({', '.join(chr(39) + b + chr(39) for b in yields.BROAD)})"
    + "".join(f" AND NOT contains(array_to_string({_WORDS('lower(' + _CUT + ')')}, ' '), '{p}')" for p in yields.EMPTY_PHRASES)
    + f" AND NOT (list_contains({_list(yields.LOOSE_HEADS)}, {_WORDS('lower(' + _CUT + ')')}[1]) AND NOT list_has_any({_WORDS('lower(' + _CUT + ')')}[2:], {_list(yields.FIRM_HEADS)})) THEN [{_CUT}] ELSE [] END"
)
_WHOLE = "regexp_replace(trim(r), ',+$', '')"
_OBJECTS = {
    "persons": f"list_filter(regexp_extract_all({_CLAUSE('r')}, '{yields.PERSON}'), lambda n: regexp_matches(n, '\\s'))",
    "capital": f"CASE WHEN regexp_matches({_WHOLE}, '^\\p{{Lu}}') THEN [{_WHOLE}] ELSE [] END",
    "work": f"CASE WHEN regexp_matches({_WHOLE}, '^\\p{{Lu}}') AND NOT contains(lower({_WHOLE}), 'range of') THEN [{_WHOLE}] ELSE [] END",
    "name": f"CASE WHEN {_NAMED(_WHOLE)} THEN [{_WHOLE}] ELSE [] END",
    "entities": _ENTITIES,
    "platforms": f"CASE WHEN contains(r, 'on-premises') THEN ['on-premises'] ELSE [] END || {_ENTITIES}",
    "aliases": _ALIASES,
    "definition": _DEFINITION,
    "whole": f"[{_WHOLE}]",
}
_UNHUNG = lambda x: "list_reduce(regexp_split_to_array({0}, '\\s+'), lambda t, w: {1}, trim({0}))".format(x, reduce(lambda y, p: f"trim(regexp_replace({y}, '{p}', '', 'g'))", yields.HANGING, "t"))
_STANDS = "(lower(l) IN (" + ", ".join(f"'{w}'" for w in yields.PAGE_WORDS) + ")" + "".join(f" OR contains(lower(l), '{m}')" for m in yields.PAGE_MARKS) + ")"


def _found(k: int, p: yields.Pattern) -> str:
    groups = ", ".join(f"unnest(regexp_extract_all(sentence, '{_regex(p.regex)}', {g})) AS {n}" for g, n in ((0, "m"), (1, "l0"), (2, "r")))
    lead = " WHERE lead" if p.names == "definition" else ""
    subject = {"page": "page_name", "or_page": f"CASE WHEN {_STANDS} THEN page_name ELSE l END", "name": "l"}[p.subject]
    body = f"SELECT *, {_CANON('l0')} AS l FROM (SELECT *, {groups}, unnest(range(len(regexp_extract_all(sentence, '{_regex(p.regex)}')))) AS nth FROM st{lead})"
    rows = f"SELECT page, place, {k} AS k, nth, m, sentence, page_name, {subject} AS subject, unnest({_OBJECTS[p.names]}) AS object FROM ({body})"
    keep = "regexp_matches(subject, '^\\p{Lu}')" if p.subject == "page" else _NAMED("subject")
    if p.names == "definition":
        title = _CANON("page_name")
        keep += f" AND instr(sentence, m) <= 11 AND NOT (NOT regexp_matches(subject, '\\s') AND regexp_matches({title}, '\\s') AND list_contains(regexp_split_to_array(lower({title}), '\\s+'), lower(subject)))"
    a, b = ("object", "subject") if p.inverse else ("subject", "object")
    ends = (f"trim({a})", b) if p.names == "definition" else (_UNHUNG(a), _UNHUNG(b))
    return f"SELECT page, place, k, nth, '{p.id}' AS pattern_id, {ends[0]} AS subject, '{p.predicate}' AS predicate, {ends[1]} AS object, '{p.risk}' AS risk, '{p.stability}' AS stability, sentence FROM ({rows}) WHERE object != '' AND {keep}"


_YIELDED = f"""WITH pages AS ({_DUCK}), ps AS (SELECT page, {_TITLE} AS page_name, {_PARAGRAPHS} AS ps FROM pages),
 ss AS (SELECT page, page_name, flatten(list_transform(ps, lambda p, k: list_transform({_SPLIT('p')}, lambda s, j: {{'s': s, 'lead': k = 1 AND j = 1}}))) AS ss FROM ps),
 st AS (SELECT page, page_name, i - 1 AS place, ss[i].s AS sentence, ss[i].lead AS lead FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM ss) WHERE NOT regexp_matches(regexp_replace(ss[i].s, '{yields.ASIDE}', ',', 'g'), '{_quoted(yields.NEGATED)}') AND NOT regexp_matches(ss[i].s, '{yields.UNSAFE}')),
 f AS ({' UNION ALL '.join(_found(k, p) for k, p in enumerate(yields.PATTERNS))}),
 g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY page, lower(subject), predicate, CASE WHEN predicate != 'is_a' THEN lower(object) END ORDER BY place, k, nth, object) = 1) """
_COLUMNS = "page, place::BIGINT AS place, pattern_id, subject, predicate, object, risk, stability, sentence"


def _pages(spark, sf_dir):
    return read(spark, sf_dir, _SPARK, "orders", "lineitem")


def _facts(spark, sf_dir):
    from pyspark.sql import functions as F

    rows = pages.page_sentences(_pages(spark, sf_dir).withColumn("title", pages.title(F.col("text"), F.col("page").cast("string"))))
    return yields.yielded(rows).withColumn("place", F.col("place").cast("long"))


@query(_YIELDED + f"SELECT {_COLUMNS} FROM g")
def yield_v2_facts(spark, sf_dir):
    """Facts of all pages' sentences by all patterns, each once in a page."""
    return _facts(spark, sf_dir)


@query(_YIELDED + f"SELECT {_COLUMNS} FROM (SELECT *, min(page) OVER (PARTITION BY lower(subject), predicate, CASE WHEN predicate != 'is_a' THEN lower(object) END) AS first FROM g) WHERE page = first")
def yield_v2_across_pages(spark, sf_dir):
    """Of the facts of all pages those that no earlier page has."""
    return yields.across_pages(_facts(spark, sf_dir))


# --- definitions from first sentences, in SQL step by step ---

_RTRIM = lambda x, marks: f"regexp_replace({x}, '[{marks}]+$', '')"
_PLAIN_WORDS = lambda x: f"array_to_string({_WORDS(f'lower({x})')}, ' ')"
_SHORT = lambda x: f"CASE WHEN length({x}) > {pages.MOST_LETTERS} THEN {_RTRIM('trim(regexp_replace(substr(' + x + f', 1, {pages.MOST_LETTERS}), ' + chr(39) + chr(92) + 's' + chr(92) + 'S*$' + chr(39) + ', ' + chr(39) * 2 + '))', ' ,;:')} ELSE {x} END"


def _phrase(source: str, columns: str, name: str, table: str) -> str:
    """Steps that shorten ``source`` of a table to a noun phrase, as tables."""
    before = _RTRIM(f"trim(regexp_extract({name}0, '(?s)^([^,]{{16,}}?),', 1))", " ,;:")
    last = f"lower({_RTRIM(f'coalesce({_WORDS(before)}[-1], {chr(39) * 2})', '.,;:')})"
    clause = _RTRIM(f"trim(regexp_extract({name}1, '{pages.CLAUSE}', 1))", " ,;:")
    return f"""{name}a AS (SELECT *, {_RTRIM(f'trim({source})', ' .')} AS {name}0 FROM {table}),
 {name}b AS (SELECT *, CASE WHEN {before} != '' AND {last} NOT IN {tuple(pages.OPEN_ENDS)} THEN {before} ELSE {name}0 END AS {name}1 FROM {name}a),
 {name}c AS (SELECT *, CASE WHEN {clause} != '' THEN {clause} ELSE {name}1 END AS {name}2 FROM {name}b),
 {name}d AS (SELECT *, {_SHORT(name + '2')} AS {name}3 FROM {name}c),
 {name}e AS (SELECT *, {_RTRIM(f"trim(regexp_replace({name}3, '(?i)^(?:a|an|the){chr(92)}s+', ''))", ' ,;:')} AS {name} FROM {name}d)"""


_BAD = " OR ".join(
    [
        f"NOT regexp_matches(s, '{pages.COPULA}')", f"length(regexp_extract(s, '{pages.COPULA}', 1)) > {pages.FARTHEST}", f"len({_WORDS('found')}) NOT BETWEEN 2 AND {pages.MOST_WORDS}",
        f"lower({_WORDS('found')}[1]) IN {tuple(pages.BAD_HEADS)}", f"regexp_matches(found, '{pages.RECENT}')", *(f"contains({_PLAIN_WORDS('found')}, '{p}')" for p in pages.BAD_PHRASES),
        f"lower({_RTRIM(_WORDS('found') + '[-1]', '.,;:')}) IN {tuple(pages.BAD_ENDS)}", f"(known != '' AND starts_with({_PLAIN_WORDS('found')}, known))",
    ]
)
_BARRED = " OR ".join([f"contains(' ' || known, '{m}')" for m in pages.BAD_SUBJECTS] + [f"regexp_matches(subject, '{pages.RECENT}')"])
_BOTH = _SHORT(_RTRIM(f"trim('present-day change that includes both ' || regexp_extract(s, '{pages.INCLUDES}', 2))", " ."))
_LEAD_SQL = f"""WITH pages AS ({_DUCK}), p0 AS (SELECT page, {_TITLE} AS subject, {_SPLIT(f"coalesce(({_PARAGRAPHS})[1], '')")} AS ss FROM pages),
 tries AS (SELECT page, subject, CASE WHEN len(ss) >= 2 AND (length(regexp_replace(ss[1], '[^(]', '', 'g')) > length(regexp_replace(ss[1], '[^)]', '', 'g')) OR regexp_matches(ss[2], '^\\s*["'']')) THEN [ss[1] || ' ' || ss[2]] ELSE [] END || ss[1:3] AS t FROM p0),
 each AS (SELECT page, subject, {_PLAIN_WORDS('subject')} AS known, unnest(t) AS s, unnest(range(len(t))) AS i FROM tries),
 {_phrase(f"regexp_extract(s, '{pages.COPULA}', 2)", '', 'found', 'each')},
 {_phrase(f"'period in the history of ' || regexp_extract(s, '{pages.LASTED}', 1) || ' lasting approximately ' || regexp_extract(s, '{pages.LASTED}', 2)", '', 'lasted', 'founde')},
 d AS (SELECT page, subject, s, i, CASE WHEN {_BARRED} OR s = '' THEN NULL WHEN regexp_matches(s, '{pages.LASTED}') AND len({_WORDS('lasted')}) >= 2 THEN lasted
  WHEN regexp_matches(s, '{pages.INCLUDES}') AND ends_with({_PLAIN_WORDS(f"regexp_extract(s, '{pages.INCLUDES}', 1)")}, known) AND len({_WORDS(_BOTH)}) BETWEEN 2 AND {pages.MOST_WORDS} THEN {_BOTH} WHEN NOT ({_BAD}) THEN found END AS definition FROM lastede)
SELECT page, subject, definition, s AS sentence FROM d WHERE definition IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page ORDER BY i) = 1"""


@query(_LEAD_SQL)
def lead_definitions(spark, sf_dir):
    """What the first sentences of every page say that it is."""
    return pages.lead_definitions(_pages(spark, sf_dir), "page")


# --- claims of wiki pages, from their markup; braces are put in by translate, as they would be taken for parameters ---

from factloom.operators import claims  # noqa: E402

_MARKUP = (
    "{t} is a [[Maker|maker]] of [[{b}]] known for oil. It develops the lamps, an oil and heat.", "{t} was the founder, based in [[Rome]]. He is known for his leadership of {b} and the Works of {c}.",
    "{t} are the {t}. They manufactures cloth; wool.", "Of {t} little is known. It is known for its heat, and the light.", "{t} is an estate. Its net worth was estimated by Forbes at US$1.5 billion. Fortune ranked number 7 of all.",
    "{t} was the richest man in [[{b}|the town]] by Bloomberg. The current president of it is {c}.", "{t} is a town founded in 1900. Its population is a count of 5000. The share price was US$3. A market cap of 9 was said.",
    "{t} publishes the Daily {b}. Net worth estimates vary. It produces {c}.<ref name=\"x\">no claim</ref>",
)
_BOXES = ("'««Infobox works' || chr(10) || '| founder = Ann ' || b || ' and Bob ' || c || chr(10) || '| Products = lamps, the oil; ' || b || '.' || chr(10) || '»»' || chr(10)", "'««Infobox' || chr(10) || '|known_for = heat' || chr(10) || '|known_for=light and heat' || chr(10) || '| size =' || chr(10) || '»»' || chr(10)", "'««Other|x=1»»' || chr(10)", "''")
_WIKI = f"""SELECT o_orderkey AS page, t AS title, translate({pick('o_custkey % 4', _BOXES)}, '«»', chr(123) || chr(125)) || {pick(f'o_orderkey % {len(_MARKUP)}', [_filled(f, t="t", b="b", c="c") for f in _MARKUP])} || chr(10) || chr(10) || 'More of [[Part ' || c || '|it]].' AS text,
 CASE WHEN o_custkey % 3 = 0 THEN '2021-05-06T00:00' WHEN o_custkey % 3 = 1 THEN 'May' END AS retrieved_at
 FROM (SELECT *, 'Order ' || {name_of('o_orderkey')} AS t, 'Line ' || {name_of('o_custkey')} AS b, 'Z' || lower({name_of('o_custkey')}) AS c FROM orders) AS o"""
_TIDY = lambda x: f"trim(regexp_replace(trim({x}), '\\.+$', ''))"
_THINGS = lambda x: f"list_filter(list_transform(regexp_split_to_array({x}, '{claims.OBJECTS}'), lambda p: regexp_replace({_TIDY('p')}, '(?i)^(?:the|a|an)\\s+', '')), lambda p: p != '')"
_VOLATILE = f"((regexp_matches(s, '{claims.NET_WORTH}') AND (regexp_matches(s, '{claims.AMOUNT}') OR regexp_matches(s, '(?i)\\bestimat'))) OR " + " OR ".join(f"regexp_matches(s, '{p}')" for p in claims.VOLATILE) + ")"
_EMPTY = "'' AS source_name, '' AS claim_type, 'semi_stable' AS stability, 'medium' AS risk"


def _related(predicate: str, things: str, evidence: str, source: str, where: str, order: str) -> str:
    snapshot = predicate in claims.SNAPSHOTS
    return f"SELECT page, {order} AS o, 'relation' AS kind, title AS subject, '{predicate}' AS predicate, unnest({_THINGS(things)}) AS object, unnest(range(len({_THINGS(things)}))) AS n, {evidence} AS evidence, {_EMPTY}, '{'snapshot' if snapshot else 'historical'}' AS temporal_class, {'as_of' if snapshot else chr(39) * 2} AS as_of FROM {source} WHERE {where}"


def _claims_sql() -> str:
    part = lambda p, g: f"regexp_extract(s, '{p}', {g})"
    calm, leads = f"NOT {_VOLATILE}", f"regexp_matches(s, '{claims.LEADERSHIP}')"
    rows = [_related("leader_of", part(claims.LEADERSHIP, 2), f"trim({part(claims.LEADERSHIP, 1)})", "ss", f"{calm} AND {leads}", "[1, i, 0]")]
    rows.append(_related("known_for", part(claims.KNOWN_FOR, 1), f"trim({part(claims.KNOWN_FOR, 0)})", "ss", f"{calm} AND NOT {leads} AND regexp_matches(s, '{claims.KNOWN_FOR}')", "[1, i, 1]"))
    for k, (verb, predicate) in enumerate(claims.VERBS):
        p = rf"(?i)\b{verb}\b\s+(.+?)(?:\.|$)"
        rows.append(_related(predicate, part(p, 1), f"trim({part(p, 0)})", "ss", f"{calm} AND NOT {leads} AND regexp_matches(s, '{p}')", f"[1, i, {2 + k}]"))
    value = lambda key: f"list_filter(box, lambda x: x.k = '{key}')[-1].v"
    rows += [_related(p, value(k), f"'{k}: ' || {value(k)}", "pp", f"{value(k)} IS NOT NULL", f"[2, {n}, 0]") for n, (k, p) in enumerate(claims.BOX)]
    rows += [f"SELECT page, [3, {n}, 0] AS o, 'relation' AS kind, f AS subject, 'founded' AS predicate, title AS object, n, f || ' founded ' || title AS evidence, {_EMPTY}, 'historical' AS temporal_class, '' AS as_of FROM (SELECT *, unnest({_THINGS(value(k))}) AS f, unnest(range(len({_THINGS(value(k))}))) AS n FROM pp WHERE {value(k)} IS NOT NULL)" for n, k in enumerate(claims.FOUNDERS)]
    rows.append("SELECT page, [4, 0, 0] AS o, 'context_link' AS kind, title AS subject, 'mentioned_with' AS predicate, x.target AS object, n, x.surface AS evidence, '' AS source_name, '' AS claim_type, '' AS stability, '' AS risk, '' AS temporal_class, '' AS as_of FROM (SELECT *, unnest(links) AS x, unnest(range(len(links))) AS n FROM pp)")
    amount = f"trim({part(claims.AMOUNT, 1)})"
    cases = [
        (f"regexp_matches(s, '{claims.NET_WORTH}') AND (contains(lower(s), 'estimat') OR {amount} != '')", "estimated_net_worth", f"CASE WHEN {amount} != '' THEN {amount} ELSE '{claims.NO_AMOUNT}' END", "estimate"),
        (f"regexp_matches(s, '{claims.WEALTHIEST}')", "wealth_rank", "s", "ranking"), (f"regexp_matches(s, '{claims.RANKED}')", "ranking", f"'rank ' || {part(claims.RANKED, 1)}", "ranking"),
        ("contains(lower(s), 'current') AND (" + " OR ".join(f"contains(lower(s), '{o}')" for o in claims.OFFICES) + ")", "current_office_holder", "s", "office"),
        ("contains(lower(s), 'market cap')", "market_capitalization", "s", "estimate"), ("contains(lower(s), 'price')", "current_price", "s", "estimate"), ("contains(lower(s), 'population')", "current_population", "s", "estimate"), ("true", "current_estimate", "s", "estimate"),
    ]
    which = lambda f: "CASE " + " ".join(f"WHEN {c[0]} THEN {f(c)}" for c in cases) + " END"
    source = "CASE " + " ".join(f"WHEN contains(lower(s), '{x.lower()}') THEN '{x}'" for x in claims.SOURCES) + " ELSE 'unknown_source' END"
    kind, claim = which(lambda c: f"'{c[1]}'"), which(lambda c: f"'time_sensitive_{c[3]}'")
    rows.append(f"SELECT page, [5, i, 0] AS o, 'source_fact' AS kind, title AS subject, {kind} AS predicate, {which(lambda c: c[2])} AS object, 0 AS n, s AS evidence, {source} AS source_name, {claim} AS claim_type, 'volatile' AS stability, 'high' AS risk, 'snapshot' AS temporal_class, as_of FROM ss WHERE {_VOLATILE}")
    define = _TIDY(f"regexp_extract(trim(regexp_extract(s, '{claims.COPULA}', 1)), '{claims.DEFINITION}', 1)")
    plain = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    rows.insert(0, f"SELECT page, [0, 0, 0] AS o, 'definition' AS kind, title AS subject, 'is_a' AS predicate, d AS object, 0 AS n, s AS evidence, '' AS source_name, '' AS claim_type, 'stable' AS stability, 'low' AS risk, 'historical' AS temporal_class, '' AS as_of FROM (SELECT *, {define} AS d FROM ss WHERE i = 0) WHERE d != '' AND {plain('title')} != {plain('d')}")
    field, link = "'(?m)^\\s*\\|\\s*([^=|\\n]+?)\\s*=[ \\t]*([^\\n]*?)\\s*$'", "'\\[\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]\\]'"
    lead = "regexp_replace(regexp_replace(regexp_split_to_array(trim(regexp_replace(regexp_replace(text, '\\{\\{[^{}]*\\}\\}', '', 'g'), '<ref[^>]*/>|<ref[^>]*>.*?</ref>', '', 'g'), chr(10) || ' '), '\\n\\s*\\n')[1], '\\[\\[(?:[^\\]|]+\\|)?([^\\]]+)\\]\\]', '\\1', 'g'), '''{2,}', '', 'g')"
    return f"""WITH w AS ({_WIKI.replace('AS STRING', 'AS VARCHAR')}), b AS (SELECT *, regexp_extract(text, '(?i)\\{{\\{{Infobox([^{{}}]*)\\}}\\}}', 1) AS bt FROM w),
 pp AS (SELECT page, title, list_transform(list_zip(regexp_extract_all(bt, {field}, 1), regexp_extract_all(bt, {field}, 2)), lambda x: {{'k': lower(x[1]), 'v': x[2]}}) AS box,
  list_transform(list_zip(regexp_extract_all(text, {link}, 1), regexp_extract_all(text, {link}, 2)), lambda x: {{'target': trim(x[1]), 'surface': trim(CASE WHEN x[2] != '' THEN x[2] ELSE x[1] END)}}) AS links,
  CASE WHEN regexp_matches(retrieved_at, '^\\d{{4}}-\\d{{2}}') THEN retrieved_at[:7] ELSE coalesce(retrieved_at, '') END AS as_of, trim(regexp_replace({lead}, '\\s+', ' ', 'g')) AS lead FROM b),
 ss AS (SELECT page, title, as_of, unnest(l) AS s, unnest(range(len(l))) AS i FROM (SELECT *, list_filter(list_transform(string_split(regexp_replace(lead, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s)), lambda s: s != '') AS l FROM pp)),
 c AS ({' UNION ALL '.join(rows)})
SELECT page, row_number() OVER (PARTITION BY page ORDER BY o, n) - 1 AS place, kind, subject, predicate, object, evidence, source_name, claim_type, stability, risk, temporal_class, as_of FROM c"""


@query(_claims_sql())
def page_claims(spark, sf_dir):
    """Definitions, relations, links and facts with sources of every page, from one scan."""
    return claims.claims(read(spark, sf_dir, _WIKI, "orders"))


_TEMPLATES = ("«subject» moved", "«subject» was found in «location»", "«subject» came", "«subject» caused «object» to «action»")
_CANDIDATES = f"""SELECT 'src' || p_size AS source_id, p_brand AS term, p_type AS sense, {pick('p_partkey % 2', ["'action'", "'location'"])} AS pattern_type, {pick('p_partkey % 3', ["'mechanical_device'", "'bird_behavior'", "p_name"])} AS frame, translate({pick('p_partkey % 4', [f"'{t}'" for t in _TEMPLATES])}, '«»', chr(123) || chr(125)) AS template FROM part"""
_SLOTS = "regexp_extract_all(template, '\\{(\\w+)\\}', 1)"
_GENERIC = "lower(trim(template)) IN (" + ", ".join(f"'{t}'" for t in claims.GENERIC_TEMPLATES) + ")"
_FRAMED = "frame IN (" + ", ".join(f"'{f}'" for f in claims.FRAMES) + ")"


@query(f"""WITH c AS ({_CANDIDATES.replace('AS STRING', 'AS VARCHAR')}), j AS (SELECT 'pat-' || sha256(concat_ws('|', source_id, term, sense, pattern_type, template))[:12] AS pattern_id, min(array_to_string({_SLOTS}, ',')) AS slots, template FROM c GROUP BY ALL),
 f AS (SELECT 'pat-' || sha256(concat_ws('|', source_id, term, sense, pattern_type, template))[:12] AS pattern_id, min(frame) AS frame FROM c GROUP BY ALL)
SELECT pattern_id, slots, CASE WHEN {_GENERIC} OR len(list_filter(string_split(slots, ','), lambda x: x NOT IN ('subject', ''))) = 0 THEN 'rejected_auto' WHEN NOT {_FRAMED} THEN 'needs_review' ELSE 'accepted_auto' END AS decision,
 CASE WHEN {_GENERIC} THEN 'generic_template' WHEN len(list_filter(string_split(slots, ','), lambda x: x NOT IN ('subject', ''))) = 0 THEN 'no_concrete_slots' WHEN NOT {_FRAMED} THEN 'unknown_semantic_frame:' || frame ELSE 'concrete_slots_known_frame' END AS reason FROM j JOIN f USING (pattern_id)""")
def sentence_patterns(spark, sf_dir):
    """Candidate sentence patterns, each once, with their decision."""
    from pyspark.sql import functions as F

    rows = read(spark, sf_dir, _CANDIDATES, "part").groupBy("source_id", "term", "sense", "pattern_type", "template").agg(F.min("frame").alias("frame"))
    return claims.judged_patterns(rows).select("pattern_id", "slots", "decision", "reason")
