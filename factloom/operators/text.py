"""Text operators: hashes, gates, n-grams, co-occurrence, overlap with a benchmark, lexical search, extraction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.lineage import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(text: Column) -> Column:
    """Lower case A-Z, other than letters, digits and line ends become one space."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(plain(text), " "), lambda t: t != "")


def content_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the plain text."""
    return F.substring(F.sha2(F.encode(plain(text), "UTF-8"), 256), 1, 16)


def duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, hash, first_doc, is_duplicate): the first document of each content hash wins."""
    rows = cut(documents.select("doc_id", content_hash(F.col("text")).alias("hash")))
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("first_doc"))
    return rows.join(first, "hash").select("doc_id", "hash", "first_doc", (F.col("doc_id") != F.col("first_doc")).cast("int").alias("is_duplicate"))


def gate(text: Column) -> Column:
    """First reason for which a text is refused, in a fixed order; ``accept`` for others."""
    words = F.size(tokens(text))
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")).isin("", "[deleted]", "[removed]"), "deleted_or_empty")
        .when(F.length(text) < 40, "too_short")
        .when(F.contains(text, F.lit("!! ")), "shouting")
        .when(F.size(F.array_distinct(tokens(text))) * 4 < words, "repetitive")
        .otherwise("accept")
    )


def ngrams(text: Column, n: int) -> Column:
    """All n-grams of a text's tokens, in order; the text is split once, as a variable of a transform."""

    def grams(own: Column) -> Column:
        starts = F.slice(own, F.lit(1), F.greatest(F.size(own) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, k: w if n == 1 else F.array_join(F.slice(own, k + 1, F.lit(n)), " "))

    return F.flatten(F.transform(F.array(tokens(text)), grams))


# Words of whole texts that are counted at once in a task; what is equal in them leaves it as one row.
_BLOCK = 1 << 20
_WORD, _TABLE = re.compile("[a-z0-9]+"), str.maketrans(_UPPER, _LOWER)


def _blocks(batches: Iterable[pa.RecordBatch], pieces: Callable[[str], list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(codes of words in order, number of the piece of each, words in order of code): blocks of whole texts."""

    def block() -> tuple[np.ndarray, np.ndarray, pa.Array]:
        codes, names = pd.factorize(np.array(words, dtype=object), sort=True)
        return codes.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), pa.array(names, pa.string())

    words, sizes = [], []
    for batch in batches:
        for text in batch.column(0):
            for piece in pieces((text.as_py() or "").translate(_TABLE)):
                own = _WORD.findall(piece)
                words += own
                sizes.append(len(own))
            if len(words) >= _BLOCK:
                yield block()
                words, sizes = [], []
    if words:
        yield block()


def _gram_counts(n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(ngram, n_occurrences, n_documents) of each block of texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, text, names in _blocks(batches, lambda t: [t]):
            at = np.flatnonzero(text[: max(len(codes) - n + 1, 0)] == text[n - 1 :])
            gram = codes[at]
            for k in range(1, n):
                gram = pd.factorize(gram * len(names) + codes[at + k])[0]
            if not len(at):
                continue
            gram = pd.factorize(gram)[0]
            first = np.empty(gram.max() + 1, np.int64)
            first[gram[::-1]] = at[::-1]
            texts = int(text[-1]) + 1
            once = pd.unique(gram * texts + text[at]) // texts
            parts = [names.take(pa.array(codes[first + k])) for k in range(n)]
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*parts, " "), pa.array(np.bincount(gram)), pa.array(np.bincount(once))], ["ngram", "n_occurrences", "n_documents"])

    return count


def _pair_counts(window: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, weight) of each block of texts: unordered pairs of words within ``window`` places of a line."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, line, names in _blocks(batches, lambda t: t.split("\n")):
            keys = []
            for lag in range(1, min(window, len(codes) - 1) + 1):
                a, b = codes[:-lag], codes[lag:]
                meet = (line[:-lag] == line[lag:]) & (a != b)
                a, b = a[meet], b[meet]
                keys.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
            key, weight = np.unique(np.concatenate(keys or [codes[:0]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(key // len(names))), names.take(pa.array(key % len(names))), pa.array(weight)], ["a", "b", "weight"])

    return count


def grams_of_blocks(documents: DataFrame, n: int) -> DataFrame:
    """(ngram, n_occurrences, n_documents): n-grams counted within blocks of texts, so one n-gram may have several rows.

    They are dealt by n-gram, so a grouping by it needs no map of a whole split's n-grams in one task.
    """
    return documents.select("text").mapInArrow(_gram_counts(n), "ngram string, n_occurrences long, n_documents long").repartition("ngram")


def ngram_counts(documents: DataFrame, n: int, least: int = 2) -> DataFrame:
    """(ngram, n_occurrences, n_documents) of n-grams that occur ``least`` times or more; each row is a document."""
    found = grams_of_blocks(documents, n).groupBy("ngram").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_documents").alias("n_documents"))
    return found.where(F.col("n_occurrences") >= least)


def cooccurrence(documents: DataFrame, window: int = 4, least: int = 5) -> DataFrame:
    """(a, b, weight): unordered word pairs within ``window`` places of one line, of ``least`` or more; counted within blocks of texts first."""
    rows = documents.select("text").mapInArrow(_pair_counts(window), "a string, b string, weight long").repartition("a", "b")
    return rows.groupBy("a", "b").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= least)


def overlap(documents: DataFrame, benchmark: DataFrame, n: int = 4) -> DataFrame:
    """(doc_id, n_shared): distinct n-grams that a document shares with the benchmark; joined by n-gram."""
    known = benchmark.select(F.explode(ngrams(F.col("text"), n)).alias("gram")).distinct()
    rows = documents.select("doc_id", F.explode(F.array_distinct(ngrams(F.col("text"), n))).alias("gram"))
    return rows.join(known, "gram").groupBy("doc_id").agg(F.count("*").alias("n_shared"))


def lexical_search(documents: DataFrame, questions: DataFrame, top: int = 3, least: int = 2) -> DataFrame:
    """(item_id, rank, doc_id, matched): documents with most distinct long words of each question, ties to the smaller id."""
    long_words = lambda text: F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) >= 9))
    asked = questions.select("item_id", F.explode(long_words(F.col("text"))).alias("word"))
    rows = documents.select("doc_id", F.explode(long_words(F.col("text"))).alias("word"))
    hits = rows.join(asked, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("matched")).where(F.col("matched") >= least)
    order = Window.partitionBy("item_id").orderBy(F.desc("matched"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "matched")


# Sentence patterns, each with its predicate; the group is the object.
PATTERNS = (
    ("released_under", r"[Rr]eleased under the ([A-Za-z0-9 ]+) License"),
    ("licensed_under", r"[Ll]icensed under the ([A-Za-z0-9 ]+) License"),
    ("founded_by", r"was founded by ([A-Z][a-z]+)"),
)


def extracted_relations(documents: DataFrame) -> DataFrame:
    """(doc_id, predicate, object): distinct facts that the patterns find in the lines of a text."""
    lines = documents.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    found = F.array(*(F.struct(F.lit(name).alias("predicate"), F.regexp_extract("line", pattern, 1).alias("object")) for name, pattern in PATTERNS))
    rows = lines.where(" OR ".join(f"line RLIKE '{pattern}'" for _, pattern in PATTERNS)).select("doc_id", F.explode(found).alias("r"))
    return rows.select("doc_id", "r.predicate", "r.object").where("object != ''").distinct()


def top_terms(turns: DataFrame, top: int = 50) -> DataFrame:
    """(role, rank, term, n): the terms that each role uses most, ties in order of the term."""
    rows = turns.select("role", F.explode(tokens(F.col("text"))).alias("term")).groupBy("role", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("role").orderBy(F.desc("n"), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("role", "rank", "term", "n")


def turn_counters(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_counter, confirmed_counter): turns so far, and answered ones so far."""
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    confirmed = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(so_far)
    return turns.select("conv_id", "turn", F.count("*").over(so_far).alias("turn_counter"), confirmed.alias("confirmed_counter"))
