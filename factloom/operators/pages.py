"""Pages of text with a title and a block of metadata: body, paragraphs, sentences, and definitions from their first sentences.

A page is a title line ``# Title``, lines ``Key: value``, then paragraphs between blank lines and headings. All of it is
column expressions over whole texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abbreviations whose period doesn't end a sentence; the least length of a sentence.
ABBREVIATIONS = (
    r"Inc|Corp|Ltd|L\.P|L\.L\.C|LLC|LLP|PLC|S\.A|GmbH|B\.V|U\.S|U\.K|U\.N|E\.U|U\.A\.E|Ph\.D|Dr|Mr|Mrs|Ms|St|Ave|Blvd|Dept|Govt|Est"
    r"|approx|vs|etc|e\.g|i\.e|cf|ca|al|vol|no|fig|ed|rev|eq|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
)
LEAST_SENTENCE = 15
_META = r"[A-Za-z][A-Za-z0-9 /-]+:[^\n]*"
#: Stands for the period of an abbreviation while sentences are split.
_HELD = "\x01"


def title(text: Column, otherwise: Column) -> Column:
    """The first title line, or a page's name."""
    found = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1))
    return F.when(found != "", found).otherwise(F.trim(F.translate(otherwise, "_", " ")))


def body(text: Column) -> Column:
    """What follows the title and metadata at the top."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.trim(F.regexp_replace(text, rf"\A(?:[ \t]*+(?:# [^\n]*+|{_META})?[ \t]*+(?:\n|\z))*+", ""))


def paragraphs(text: Column) -> Column:
    """Array of paragraphs, each on one line; headings part them and go."""
    parts = F.split(F.regexp_replace(text, r"(?m)^[ \t]*#.*$", ""), r"\n(?:[ \t]*\n)+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[ \t]*\n[ \t]*", " "))), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Array of a paragraph's sentences: split after a mark before a capital or a quote, not after abbreviations; short ones go."""
    held = F.regexp_replace(text, rf"(?i)\b(?=[a-z.]{{2,6}}\.)({ABBREVIATIONS})\.", f"$1{_HELD}")
    parts = F.transform(F.split(held, r'(?<=[.!?])\s+(?=[A-Z"])'), lambda s: F.trim(F.translate(s, _HELD, ".")))
    return F.filter(parts, lambda s: F.length(s) >= LEAST_SENTENCE)


def page_sentences(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds place, sentence and lead: one row for each sentence, in order; ``lead`` is the first one of the first paragraph."""
    each = F.transform(paragraphs(body(F.col(text))), lambda p, k: F.transform(sentences(p), lambda s, j: F.struct(s.alias("sentence"), ((k == 0) & (j == 0)).alias("lead"))))
    return pages.select(*(c for c in pages.columns if c != text), F.posexplode(F.flatten(each)).alias("place", "_s")).select("*", "_s.sentence", "_s.lead").drop("_s")


# Fixed values of definitions: copulas, ends of a noun phrase, words and phrases that make none.
COPULA = r"(?is)^(.*?)\b(?:is|are|was|were)\s+(?:a|an|the|any)\s+(.*)$"
LASTED = r"(?i)^In the history of ([^,]+),\s+.+?\s+lasted approximately\s+(from\s+.+?)(?:,\s+|\.|$)"
INCLUDES = r"(?i)^(?:Present-day\s+)?(.+?)\s+includes both\s+(.+?)\.$"
CLAUSE = r"(?is)^(.{16,}?)\s+(?:which|who|that|while|although|but|including|covering|comprising|succeeding)\b.*$"
BAD_HEADS = ("one", "same", "some", "many", "several", "former", "current", "latest")
BAD_SUBJECTS = (" election", " elections", " congress", " convention", " census", " primaries", " caucuses", " debates", " referendum")
BAD_PHRASES = (
    "meeting of the legislative branch", "election for the united states", "series of electoral contests", "series of primary elections", "series of debates", "involved in the various aspects",
    "political event to select",
)
BAD_ENDS = ("a", "an", "and", "at", "by", "for", "from", "in", "of", "on", "the", "to", "with")
OPEN_ENDS = ("existence", "production", "widespread")
RECENT = r"\b202[3-9]\b"
MOST_LETTERS, MOST_WORDS, FARTHEST = 180, 30, 220


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _plain(text: Column) -> Column:
    return F.array_join(_words(F.lower(text)), " ")


def _without(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, rf"[{marks}]+$", "")


def _shortened(text: Column) -> Column:
    cut = F.regexp_replace(F.substring(text, 1, MOST_LETTERS), r"\s\S*$", "")
    return F.when(F.length(text) > MOST_LETTERS, _without(F.trim(cut), " ,;:")).otherwise(text)


def noun_phrase(text: Column) -> Column:
    """The noun phrase that a text begins with: up to a comma, a clause, and 180 letters, without its article."""
    text = _without(F.trim(text), " .")
    before = _without(F.trim(F.regexp_extract(text, r"(?s)^([^,]{16,}?),", 1)), " ,;:")
    last = F.lower(_without(F.coalesce(F.try_element_at(_words(before), F.lit(-1)), F.lit("")), ".,;:"))
    text = F.when((before != "") & ~last.isin(*OPEN_ENDS), before).otherwise(text)
    clause = _without(F.trim(F.regexp_extract(text, CLAUSE, 1)), " ,;:")
    text = _shortened(F.when(clause != "", clause).otherwise(text))
    return _without(F.trim(F.regexp_replace(text, r"(?i)^(?:a|an|the)\s+", "")), " ,;:")


def with_definition(rows: DataFrame) -> DataFrame:
    """Adds ``definition`` to (subject, sentence): what the sentence says that the subject is, null where it gives no definition."""
    sentence, name = F.coalesce(F.col("sentence"), F.lit("")), F.col("subject")
    period = F.concat(F.lit("period in the history of "), F.regexp_extract(sentence, LASTED, 1), F.lit(" lasting approximately "), F.regexp_extract(sentence, LASTED, 2))
    change = _without(F.trim(F.concat(F.lit("present-day change that includes both "), F.regexp_extract(sentence, INCLUDES, 2))), " .")
    # each step is a column of its own, so that what is used more than once is computed once
    steps = rows.withColumns({"_before": F.regexp_extract(sentence, COPULA, 1), "_raw": F.regexp_extract(sentence, COPULA, 2), "_known": _plain(name)})
    steps = steps.withColumns({"_found": noun_phrase(F.col("_raw")), "_lasted": F.when(sentence.rlike(LASTED), noun_phrase(period)), "_both": F.when(sentence.rlike(INCLUDES), _shortened(change))})
    steps = steps.withColumns({"_words": _words(F.col("_found")), "_plain": _plain(F.col("_found"))})
    known, plain, words = F.col("_known"), F.col("_plain"), F.col("_words")
    bad = [
        ~sentence.rlike(COPULA),
        F.length("_before") > FARTHEST,
        (F.size(words) < 2) | (F.size(words) > MOST_WORDS),
        F.lower(F.try_element_at(words, F.lit(1))).isin(*BAD_HEADS),
        F.col("_found").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]") | F.col("_found").rlike(RECENT),
        *(F.contains(plain, F.lit(p)) for p in BAD_PHRASES),
        F.lower(_without(F.try_element_at(words, F.lit(-1)), ".,;:")).isin(*BAD_ENDS),
        (known != "") & F.startswith(plain, known),
    ]
    barred = reduce(lambda a, b: a | b, (F.contains(F.concat(F.lit(" "), known), F.lit(m)) for m in BAD_SUBJECTS), name.rlike(RECENT))
    whole = F.endswith(_plain(F.regexp_extract(sentence, INCLUDES, 1)), known) & F.size(_words(F.col("_both"))).between(2, MOST_WORDS)
    found = F.when(~F.coalesce(reduce(lambda a, b: a | b, bad), F.lit(True)), F.col("_found"))
    definition = F.when(barred | (sentence == ""), F.lit(None)).when(F.size(_words(F.col("_lasted"))) >= 2, F.col("_lasted")).when(whole, F.col("_both")).otherwise(found)
    return steps.withColumn("definition", definition).drop("_before", "_raw", "_known", "_found", "_lasted", "_both", "_words", "_plain")


def lead_definitions(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, subject, definition, sentence): for each page the first definition among its first three sentences.

    If the first sentence leaves a bracket open, or the second begins with a quote, both together are tried first.
    """
    first = F.try_element_at(paragraphs(body(F.col(text))), F.lit(1))
    rows = pages.select(key, title(F.col(text), F.col(key).cast("string")).alias("subject"), sentences(F.coalesce(first, F.lit(""))).alias("s"))
    one, two = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    opened = F.length(F.regexp_replace(one, r"[^(]", "")) > F.length(F.regexp_replace(one, r"[^)]", ""))
    joined = F.when((F.size("s") >= 2) & (opened | two.rlike(r"""^\s*["']""")), F.array(F.concat_ws(" ", one, two))).otherwise(F.array().cast("array<string>"))
    tried = rows.select(key, "subject", F.posexplode(F.concat(joined, F.slice("s", 1, 3))).alias("_n", "sentence"))
    # a filter on definitions would be moved below their steps and repeat each once for each use
    best = with_definition(tried).groupBy(key, "subject").agg(F.min(F.when(F.col("definition").isNotNull(), F.struct("_n", "definition", "sentence"))).alias("d")).where("d IS NOT NULL")
    return best.select(key, "subject", "d.definition", "d.sentence")
