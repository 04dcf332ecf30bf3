"""Registered queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import ann, collocations, decontaminate, html_extract, language_model, licenses, line_dedup, ngram_join, packing, prefix_trie, quality, secrets, url_filter
from factloom.llm.shared import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 5-word shingles at a similarity of 0.8: sizes, components, numbers of links."""
    out = ngram_join.similar(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "n_links")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    out = url_filter.with_verdict(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document, with its place and edits."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.with_main_text(_table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from labels that aren't held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality.with_score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their bins, capacities and offsets."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash and spans of the secrets of every document."""
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines it shares with earlier documents."""
    out = line_dedup.without_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", "text")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences and licenses of every document."""
    out = licenses.with_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids, names = F.array_join("sentence_ids", ","), F.array_join("licenses", ",")
    return out.select("doc_id", ids.alias("sentence_ids"), names.alias("licenses"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op10_licenses_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License sentences of a larger vocabulary, wrapped or not, and licenses of every document."""
    out = licenses.with_wrapped_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids, names = F.array_join("sentence_ids", ","), F.array_join("licenses", ",")
    return out.select("doc_id", ids.alias("sentence_ids"), names.alias("licenses"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document by a model of those that aren't held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out = language_model.scored(_table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    turns = prefix_trie.turns_of(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline, applied to documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_ngram_join, op2_url_filter, op3_decontamination, op4_html_extraction, op5_quality, op6_packing, op7_secrets, op8_line_dedup, op9_ann, op10_licenses, op10_licenses_wrapped, op11_lm_scores, op12_conversation_trie, op13_collocations, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.oracle(), "op10_licenses": licenses.oracle(), "op12_conversation_trie": prefix_trie.oracle(), "op13_collocations": collocations.oracle()}
