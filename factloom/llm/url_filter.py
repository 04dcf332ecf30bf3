"""URL filter: host and path rules first, else a weighted vocabulary of URL terms.

An Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased URL. A
hit counts only between boundaries (no ASCII letter or digit on either side). One strict
term, or ``min_soft`` distinct soft terms, block the URL.
"""

from __future__ import annotations

import pkgutil
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Weight from which a term blocks alone.
STRICT_WEIGHT = 1.0


def parse_vocabulary(text: str) -> dict[str, float]:
    """Terms and weights from lines of a term, a tab and a weight; blank lines and lines that begin with # are skipped, of a repeated term the largest weight counts."""
    out: dict[str, float] = {}
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            term, weight = line.rsplit("\t", 1)
            out[term.strip().lower()] = max(float(weight), out.get(term.strip().lower(), 0.0))
    return out


def vocabulary_of(table: DataFrame, term: str = "term", weight: str = "weight", most: int = 1_000_000) -> dict[str, float]:
    """The vocabulary of a table, which must not have more than ``most`` rows."""
    rows = table.select(F.lower(F.trim(term)).alias("t"), F.col(weight).cast("double").alias("w")).dropna().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    out: dict[str, float] = {}
    for r in rows:
        out[r["t"]] = max(r["w"], out.get(r["t"], 0.0))
    return out


VOCABULARY = parse_vocabulary(pkgutil.get_data("factloom.llm", "url_terms.tsv").decode())
#: Terms of which one blocks, and terms of which several distinct ones block if their weights sum to the weight of a strict one.
STRICT = tuple(t for t, w in VOCABULARY.items() if w >= STRICT_WEIGHT)
SOFT = tuple(t for t, w in VOCABULARY.items() if w < STRICT_WEIGHT)
MIN_SOFT = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def _inside(char: str) -> bool:
    return "a" <= char <= "z" or "0" <= char <= "9"


def bounded_terms(url: str, terms: tuple[str, ...]) -> set[str]:
    """Distinct terms that stand between boundaries in an already lower-cased URL."""
    return {
        term
        for end, term in _automaton(terms).iter(url)
        if not (end + 1 < len(url) and _inside(url[end + 1])) and not (end >= len(term) and _inside(url[end - len(term)]))
    }


def term_hits(url: Column, vocabulary: dict[str, float] | None = None) -> Column:
    """Struct of the numbers of distinct strict and soft terms in ``url``, and of the sum of the soft ones' weights."""
    own = VOCABULARY if vocabulary is None else vocabulary
    terms = tuple(own)

    @F.pandas_udf("n_strict long, n_soft long, weight double")
    def count(urls: pd.Series) -> pd.DataFrame:
        rows = [[own[term] for term in sorted(bounded_terms(url, terms))] if url and terms else [] for url in urls]
        soft = [[w for w in row if w < STRICT_WEIGHT] for row in rows]
        return pd.DataFrame({"n_strict": [len(row) - len(low) for row, low in zip(rows, soft, strict=True)], "n_soft": [len(low) for low in soft], "weight": [float(sum(low)) for low in soft]})

    return count(F.translate(url, _UPPER, _LOWER))


def with_verdict(pages: DataFrame, url: str = "url", rules=RULES, vocabulary: dict[str, float] | None = None, min_soft: int = MIN_SOFT) -> DataFrame:
    """Add host, path, rule, n_strict, n_soft and verdict to every row.

    A null URL, or one without ``://``, has an empty host and path. It can fit no rule; a
    null one holds no term and is allowed. The longest fitting rule decides; without one
    the vocabulary (term: weight) does: one strict term blocks, or ``min_soft`` distinct soft ones whose weights sum to
    a strict one's. URLs are read whole. Repeated rows get equal answers; an empty table gives no rows; columns of
    these names that were there before are replaced.
    """
    address = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(address, "://")
    rest = F.when(at > 0, F.substring(address, at + 3, F.length(address))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    hits = term_hits(F.col(url), vocabulary)
    rule = verdict = None
    for own_host, own_path, own_verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = (F.col("host") == own_host) | F.endswith("host", F.lit(f".{own_host}"))
        fits = fits & F.startswith("path", F.lit(own_path))
        rule = F.when(fits, own_host + own_path) if rule is None else rule.when(fits, own_host + own_path)
        verdict = F.when(fits, own_verdict) if verdict is None else verdict.when(fits, own_verdict)
    bad = (F.col("_hits.n_strict") >= 1) | ((F.col("_hits.n_soft") >= min_soft) & (F.col("_hits.weight") >= STRICT_WEIGHT - 1e-9))
    by_terms = F.when(bad, "block").otherwise("allow")
    out = pages.withColumns({"_hits": hits, "host": host, "path": path})
    out = out.withColumns({"rule": F.lit(None).cast("string") if rule is None else rule, "verdict": by_terms if verdict is None else verdict.otherwise(by_terms)})
    return out.withColumns({"n_strict": F.col("_hits.n_strict"), "n_soft": F.col("_hits.n_soft")}).drop("_hits")


def oracle(rules=RULES, strict=STRICT, soft=SOFT, min_soft: int = MIN_SOFT) -> str:
    """DuckDB SQL for page_id, host, path, rule, verdict, n_strict and n_soft of ``pages``."""
    lower = lambda x: f"translate({x}, '{_UPPER}', '{_LOWER}')"
    one = lambda term: f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::BIGINT"
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in ordered]
    soft = [t for t in soft if t not in strict]
    return f"""
    WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    b AS (SELECT page_id, {lower("url")} AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM a),
    c AS (SELECT page_id, low, {lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM b),
    d AS (SELECT *, {" + ".join(map(one, strict))} AS n_strict, {" + ".join(map(one, soft))} AS n_soft FROM c)
    SELECT page_id, host, path, CASE {" ".join(f"{f}'{h}{p}'" for f, (h, p, _) in zip(fits, ordered))} END AS rule,
           CASE {" ".join(f"{f}'{v}'" for f, (_, _, v) in zip(fits, ordered))} WHEN n_strict >= 1 OR n_soft >= {min_soft} THEN 'block' ELSE 'allow' END AS verdict,
           n_strict, n_soft
    FROM d"""
