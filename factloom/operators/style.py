"""Style of sources of lines: metre, openers, characteristic words, rhymes and proper names.

All words are counted once, by source and word, with their places and capitals; everything else is taken from these counts.
The best words of a source are cut to the few that are wanted in each task, so no task holds a source's vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.words import rhyme_key, syllables

#: A word, with a hyphen perhaps.
WORD = r"\p{L}+(?:-\p{L}+)?"
TOP_SYLLABLES, TOP_OPENERS, TOP_WORDS, LEAST_LETTERS = 3, 12, 25, 3


def lines(texts: DataFrame, source: str, text: str) -> DataFrame:
    """(source, line): lines of texts that aren't blank and no comments; a null source is none."""
    rows = texts.where(F.col(source).isNotNull()).select(F.col(source).alias("source"), F.explode(F.split(text, r"\r\n|[\r\n]")).alias("line"))
    return rows.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))


def word_counts(rows: DataFrame) -> DataFrame:
    """(source, word, n, first, inside, small): uses of each lower-cased word, as a line's first, capital within a line, and small."""
    each = rows.select("source", F.posexplode(F.regexp_extract_all("line", F.lit(WORD), F.lit(0))).alias("p", "w"))
    capital = F.col("w").rlike(r"^\p{Lu}")
    count = lambda c: F.sum(c.cast("long"))
    return each.groupBy("source", F.lower("w").alias("word")).agg(F.count("*").alias("n"), count(F.col("p") == 0).alias("first"), count((F.col("p") > 0) & capital).alias("inside"), count(F.col("w").rlike(r"^\p{Ll}")).alias("small"))


def _best(rows: DataFrame, top: int, order: list[Column], value: str, name: str) -> DataFrame:
    """(source, name): the best values of each source, in order, as an array."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    few = rows.withColumn("_r", rank).where(F.col("_r") <= top)
    return few.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def style_profiles(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(source, line_count, avg_syllables, common_syllables, top_openers, signature): one row for each source.

    A word is the more characteristic the more of its uses are the source's own, n * n / (all - n + 2); ties go to the later word.
    """
    metre = rows.where(F.col("line").rlike(r"\p{L}")).groupBy("source", syllables(F.col("line")).alias("syllables")).agg(F.count("*").alias("n"))
    average = F.round(F.sum(F.col("syllables") * F.col("n")) / F.sum("n"), 2)
    out = metre.groupBy("source").agg(F.sum("n").alias("line_count"), average.alias("avg_syllables"))
    everywhere = counts.groupBy("word").agg(F.sum("n").alias("all"))
    own = counts.where(F.length("word") >= LEAST_LETTERS).join(everywhere, "word").withColumn("score", F.col("n") * F.col("n") / (F.col("all") - F.col("n") + 2))
    lists = (
        _best(metre, TOP_SYLLABLES, [F.desc("n"), F.asc("syllables")], "syllables", "common_syllables"),
        _best(counts.where("first > 0"), TOP_OPENERS, [F.desc("first"), F.asc("word")], "word", "top_openers"),
        _best(own, TOP_WORDS, [F.desc("score"), F.desc("word")], "word", "signature"),
    )
    for found in lists:
        out = out.join(found, "source", "left")
    return out


def proper_names(counts: DataFrame) -> DataFrame:
    """(name, inside, small): words that are capital within lines twice or more, and more often than small."""
    found = counts.groupBy(F.col("word").alias("name")).agg(F.sum("inside").alias("inside"), F.sum("small").alias("small"))
    return found.where("inside >= 2 AND inside > small")


def rhyme_groups(rows: DataFrame, least: int = 2) -> DataFrame:
    """(rhyme, word, n): last words of lines by their rhyme, for rhymes with ``least`` lines or more."""
    last = F.lower(F.try_element_at(F.regexp_extract_all("line", F.lit(WORD), F.lit(0)), F.lit(-1)))
    found = rows.select(last.alias("word")).where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).withColumn("rhyme", rhyme_key(F.col("word")))
    kept = found.groupBy("rhyme").agg(F.sum("n").alias("lines")).where(F.col("lines") >= least).select("rhyme")
    return found.join(kept, "rhyme").select("rhyme", "word", "n")
