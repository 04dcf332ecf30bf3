"""Corpus pipeline: quality, line dedup, near-duplicate join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next one's ``docs``. All but the last return the columns of documents; other
columns of ``docs`` don't pass, whatever their names. Empty tables give empty results.
Rows that repeat stay repeated, but for near copies, where rows of one doc_id are one document.
A null text and an empty one are scored as the share of good labels, lose no lines, have no copies and
hold no benchmark item, so they stay or go by the first stage alone, and are packed as pieces without
words. A null doc_id is judged by its text, loses no lines and has no copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, line_dedup, ngram_join, packing, quality
from factloom.llm.shared import dropped, small_batches, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can't express the votes, the alignment or the packing; the stages are tested against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.with_score(docs, quality.fit(docs, labelled)).where("predicted = 1").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with earlier ones; those that lose all they had go."""
    small_batches(spark)
    out = line_dedup.without_common_lines(docs)
    emptied = (F.col("n_deleted") > 0) & (F.trim("text") == "")
    kept = out.where(~F.coalesce(emptied, F.lit(False)))
    changed = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id; others have no copies."""
    small_batches(spark)
    groups = ngram_join.similar(docs).where("component IS NOT NULL AND component != doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.where(~decontaminate.is_contaminated(docs, benchmark)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over documents; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if n:
            dropped(last)
    return STAGES[-1][1](spark, docs, sf_dir)
