"""Sources and sinks of fact items, records and audit events as files that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "overlay_type string, subject string, predicate string, object string, source_page string, evidence_text string, trust string, risk string, stability string, temporal_class string, as_of string"
AUDIT = "timestamp string, question string, entity string, relation_hint string, support_kind string, reason string, source string, temporal_mismatch boolean"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Fact items of JSON array files; files that hold no array of objects give no rows."""
    return spark.read.schema(ITEM).json(path, multiLine=True, mode="DROPMALFORMED").where("overlay_type IS NOT NULL")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events of JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(AUDIT).json(path, mode="DROPMALFORMED").where("timestamp IS NOT NULL")


def append_audit(events: DataFrame, path: str) -> None:
    """Add events to the log."""
    events.write.mode("append").json(path)


def composed(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of item tables in order without repeated items; the first of equal items stays."""
    rows = None
    for n, part in enumerate((base, *others)):
        part = part.withColumn("_n", F.lit(n))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    key = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != "_n"))), 256)
    first = Window.partitionBy("_key").orderBy("_n")
    return rows.withColumn("_key", key).withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_key", "_first", "_n")
