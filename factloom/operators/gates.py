"""Gates: ordered reasons to refuse or set aside a fact, a sentence or a page, and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.normalize import rule_key
from factloom.operators.text import plain

# Subjects and classes that say nothing, and phrases of unsafe sentences.
GENERIC_SUBJECTS = ("it", "this", "that", "they", "he", "she", "the company", "the organization")
BROAD_CLASSES = ("thing", "entity", "object", "group", "person", "goods")
SCREENS = (
    ("negation", "(not|never|no longer|(was|were|is|are|had|would|should|could|must)n t|cannot|can t|won t)"),
    ("live", "(currently|today|right now|stock price|share price|market cap)"),
    ("private", "(phone number|home address|private email|date of birth|social security|passport number)"),
    ("universal", "(all [a-z0-9]+ are|is every|are all|every [a-z0-9]+ is)"),
    ("volatile_year", "202[3-9]"),
)


def _verdict(verdict: str, reason: str) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))


def delta_verdict() -> Column:
    """(verdict, reason) of a fact: the first defect decides; null fields count as empty."""
    subject, found = (F.coalesce(rule_key(F.col(c)), F.lit("")) for c in ("subject", "object"))
    return (
        F.when(subject == found, _verdict("reject", "self_relation"))
        .when(subject.isin("", *GENERIC_SUBJECTS), _verdict("reject", "generic_subject"))
        .when(F.col("stability") == "volatile", _verdict("quarantine", "volatile_evidence"))
        .when((F.col("predicate") == "is_a") & found.isin(*BROAD_CLASSES), _verdict("reject", "is_a_object_too_broad"))
        .otherwise(_verdict("accept", "none"))
    )


def admission() -> Column:
    """(verdict, reason) of a fact for serving: neither volatile nor of high risk, and of known stability."""
    return (
        F.when((F.col("stability") == "volatile") | (F.col("risk") == "high"), _verdict("reject", "volatile_or_high_risk"))
        .when(~F.coalesce("stability", F.lit("")).isin("stable", "semi_stable"), _verdict("reject", "relation_stability_not_safe"))
        .otherwise(_verdict("accept", "none"))
    )


def chained(*gates: Column) -> Column:
    """(gate, verdict, reason) of the first gate that doesn't accept, else of the last; gates count from 1."""
    numbered = [F.struct(F.lit(n).alias("gate"), g["verdict"].alias("verdict"), g["reason"].alias("reason")) for n, g in enumerate(gates, 1)]
    return F.coalesce(*(F.when(g["verdict"] != "accept", n) for g, n in zip(gates, numbered, strict=True)), numbered[-1])


def counters(judged: DataFrame) -> DataFrame:
    """(predicate, verdict, reason, n): counts by predicate and verdict, by reason, and of all; ``*`` for every value."""
    out = judged.groupingSets([["predicate", "verdict"], ["verdict", "reason"], []], "predicate", "verdict", "reason").agg(
        F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in ("predicate", "verdict", "reason")))
    return out.select(*(F.when(F.col(f"_{c}") == 1, "*").otherwise(F.col(c)).alias(c) for c in ("predicate", "verdict", "reason")), "n")


def sentences(text: Column) -> Column:
    """Sentences of a text: lines, cut after full stops, question and exclamation marks."""
    cut = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\r\n]+", "$1\n"), "\n")
    return F.filter(cut, lambda s: F.trim(s) != "")


def screened(documents: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_<screen>..., n_safe): sentences by the first screen that stops them; row by row, without a shuffle."""

    def reason(sentence: Column) -> Column:
        words, out = F.concat(F.lit(" "), plain(sentence), F.lit(" ")), F.lit("safe")
        for name, phrase in reversed(SCREENS):
            out = F.when(words.rlike(f" {phrase} "), name).otherwise(out)
        return out

    rows = documents.select("doc_id", F.transform(sentences(F.col("text")), reason).alias("why"))
    count = lambda name: F.size(F.filter("why", lambda w: w == name)).cast("long")
    return rows.select("doc_id", F.size("why").cast("long").alias("n_sentences"), *(count(name).alias(f"n_{name}") for name, _ in SCREENS), count("safe").alias("n_safe"))


def readiness(pages: DataFrame, least: int = 500) -> DataFrame:
    """(page_id, ready, reasons): whether a page may be read, and all reasons against it, ``|`` between them."""
    low = F.lower(F.coalesce("html", F.lit("")))
    reasons = F.concat_ws(
        "|",
        F.when(F.length(F.coalesce("html", F.lit(""))) <= least, "raw_text_missing_or_short"),
        F.when(F.coalesce("url", F.lit("")) == "", "source_url_missing"),
        F.when(~F.contains(low, F.lit("<title>")), "title_missing"),
        F.when(F.contains(low, F.lit("page not found")) | F.contains(low, F.lit("404 not found")), "missing_or_error_page"),
        F.when(F.contains(low, F.lit("may refer to:")), "disambiguation_like_page"),
    )
    return pages.select("page_id", (reasons == "").cast("int").alias("ready"), reasons.alias("reasons"))
