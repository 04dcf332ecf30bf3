"""Audit events of answers, appended to a log by a stream that survives being stopped in the middle of a batch."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.files import AUDIT

# What tells that an answer lacked its time, and the reason where none is given.
MISMATCH = ("snapshot_requires_as_of", "snapshot_missing_as_of", "aggregate_requires_as_of", "missing as_of", "outdated snapshot", "stale snapshot")
NO_REASON = "no supported answer exists"


def temporal_mismatch(reason: Column, flags: Column) -> Column:
    """Whether a reason or a flag says that a fact's time was missing or over."""
    said = F.lower(F.coalesce(reason, F.lit("")))
    named = F.coalesce(F.array_contains(flags, "temporal_mismatch"), F.lit(False))
    for marker in MISMATCH:
        named = named | F.contains(said, F.lit(marker))
    return named


def audit_events(answers: DataFrame, source: str = "assistant_surface") -> DataFrame:
    """Audit events of the answers whose decision is ``audit``: (timestamp, question, entity, relation_hint, support_kind, reason, source, temporal_mismatch)."""
    text = F.trim(F.coalesce("answer", F.lit("")))
    reason = F.when(text != "", text).otherwise(NO_REASON)
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = answers.where("decision = 'audit'")
    return rows.select("timestamp", "question", blank("entity").alias("entity"), blank("relation_hint").alias("relation_hint"), "support_kind", reason.alias("reason"), F.lit(source).alias("source"), temporal_mismatch(reason, F.col("flags")).alias("temporal_mismatch"))


def _append(batch: DataFrame, number: int, path: str) -> None:
    batch.write.mode("overwrite").json(f"{path}/batch={number}")


def append_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that adds events to a log folder until all that is there is done.

    A batch has a folder of its own, named by its number, which the checkpoint gives again to a batch that wasn't finished; that batch
    replaces whatever the first attempt left. So no event is lost or doubled. Another stream needs a folder of its own.
    """
    return events.writeStream.foreachBatch(partial(_append, path=path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log folder; blank and malformed lines are skipped."""
    return spark.read.schema(AUDIT).json(path, mode="DROPMALFORMED", recursiveFileLookup=True).where("timestamp IS NOT NULL")
