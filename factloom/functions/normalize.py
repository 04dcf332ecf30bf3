"""Key normalizers as column expressions; each lookup family has its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def lookup_key(text: Column) -> Column:
    """Provider lookups: no quotes, backticks or full stops, one leading article dropped."""
    plain = _squeezed(F.regexp_replace(F.lower(F.trim(text)), "['`.]", ""))
    return F.regexp_replace(plain, "^(the|a|an) ", "")


def hop_key(text: Column) -> Column:
    """Graph hops: no quotes or backticks; full stops and articles stay."""
    return _squeezed(F.regexp_replace(F.lower(F.trim(text)), "['`]", ""))


def rule_key(text: Column) -> Column:
    """Rules and fact graph: lower case, white space squeezed."""
    return _squeezed(F.lower(text))


def planner_key(text: Column) -> Column:
    """Entity planner: as for rules, without a leading "the"."""
    return F.regexp_replace(rule_key(text), "^the ", "")
