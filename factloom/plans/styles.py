"""Registered queries: style profiles of the documents' sources, their proper names and rhymes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import style
from factloom.plans.shared import query, table

_LINES = "l AS (SELECT source, trim(unnest(regexp_split_to_array(text, '\\r\\n|[\\r\\n]')), ' ') AS line FROM documents WHERE source IS NOT NULL), ll AS (SELECT * FROM l WHERE line != '' AND NOT starts_with(line, '#'))"
_COUNTS = f"e AS (SELECT source, unnest(regexp_extract_all(line, '{style.WORD}')) AS w, unnest(range(len(regexp_extract_all(line, '{style.WORD}')))) AS p FROM ll), c AS (SELECT source, lower(w) AS word, count(*) AS n, count(*) FILTER (p = 0) AS first, count(*) FILTER (p > 0 AND regexp_matches(w, '^\\p{{Lu}}')) AS inside, count(*) FILTER (regexp_matches(w, '^\\p{{Ll}}')) AS small FROM e GROUP BY ALL)"
_RHYME = "CASE WHEN regexp_extract(word, '([aeiouy][^aeiouy]*[aeiouy][^aeiouy]*)$', 1) != '' THEN regexp_extract(word, '([aeiouy][^aeiouy]*[aeiouy][^aeiouy]*)$', 1) WHEN regexp_extract(word, '([aeiouy][^aeiouy]*)$', 1) != '' THEN regexp_extract(word, '([aeiouy][^aeiouy]*)$', 1) ELSE word END"
_TOP = "{0} AS (SELECT source, string_agg({1}, ' ' ORDER BY {2}) AS v FROM (SELECT * FROM {3} QUALIFY row_number() OVER (PARTITION BY source ORDER BY {2}) <= {4}) GROUP BY source)"


def _rows(spark, sf_dir):
    return style.lines(table(spark, sf_dir, "documents"), "source", "text")


@query(f"""WITH {_LINES}, {_COUNTS}, m AS (SELECT source, length(regexp_replace(lower(line), '[^aeiouy]', '', 'g')) AS syllables, count(*) AS n FROM ll WHERE regexp_matches(line, '\\p{{L}}') GROUP BY ALL),
 s AS (SELECT c.source, c.word, c.n * c.n / (g.a - c.n + 2) AS score FROM c JOIN (SELECT word, sum(n) AS a FROM c GROUP BY word) g USING (word) WHERE length(c.word) >= {style.LEAST_LETTERS}),
 {_TOP.format('t1', 'syllables::VARCHAR', 'n DESC, syllables', 'm', style.TOP_SYLLABLES)}, {_TOP.format('t2', 'word', 'first DESC, word', '(SELECT * FROM c WHERE first > 0)', style.TOP_OPENERS)}, {_TOP.format('t3', 'word', 'score DESC, word DESC', 's', style.TOP_WORDS)}
SELECT a.*, t1.v AS common_syllables, t2.v AS top_openers, t3.v AS signature FROM (SELECT source, sum(n)::BIGINT AS line_count, round(sum(syllables * n) / sum(n), 2) AS avg_syllables FROM m GROUP BY source) a LEFT JOIN t1 USING (source) LEFT JOIN t2 USING (source) LEFT JOIN t3 USING (source)""")
def style_profiles(spark, sf_dir):
    """One profile of each source of documents."""
    rows = _rows(spark, sf_dir)
    found = style.style_profiles(rows, style.word_counts(rows))
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in ("common_syllables", "top_openers", "signature")})


@query(f"WITH {_LINES}, {_COUNTS} SELECT word AS name, sum(inside)::BIGINT AS inside, sum(small)::BIGINT AS small FROM c GROUP BY word HAVING sum(inside) >= 2 AND sum(inside) > sum(small)")
def proper_names(spark, sf_dir):
    """Words that are mostly capital within lines of documents."""
    return style.proper_names(style.word_counts(_rows(spark, sf_dir)))


@query(f"WITH {_LINES}, w AS (SELECT lower(regexp_extract_all(line, '{style.WORD}')[-1]) AS word FROM ll), n AS (SELECT word, count(*) AS n, {_RHYME} AS rhyme FROM w WHERE word IS NOT NULL GROUP BY word) SELECT rhyme, word, n FROM n WHERE rhyme IN (SELECT rhyme FROM n GROUP BY rhyme HAVING sum(n) >= 2)")
def line_rhymes(spark, sf_dir):
    """Last words of documents' lines by rhyme."""
    return style.rhyme_groups(_rows(spark, sf_dir))
