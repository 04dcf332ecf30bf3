"""Where queries and their SQL are registered, and the SQL of the facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.facts import facts_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REASON = """CASE WHEN temporal_class IN ('snapshot', 'aggregate') AND as_of = '' THEN 'snapshot_missing_as_of:' || predicate
 WHEN stability = 'volatile' THEN 'volatile_relation:' || predicate WHEN risk = 'high' THEN 'high_risk_relation:' || predicate
 WHEN predicate IN ('leader_of', 'valued_at') AND NOT (temporal_class = 'snapshot' AND as_of != '') THEN 'current_sensitive:' || predicate END"""

#: Rows of the event stream, plain texts and their tokens.
ALERTS = "WITH a AS (SELECT event_id, epoch_us(ts) AS us, ts, user_id AS actor, json_extract_string(props, '$.k')::BIGINT % 5 AS host, event_type AS technique FROM events) "
PLAIN = "trim(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = f"list_filter(string_split({PLAIN}, ' '), lambda t: t != '')"


def view(*predicates: str) -> str:
    """Facts of some predicates, or of all, and the safe ones, as common table expressions."""
    body = facts_sql(*predicates).replace("AS STRING", "AS VARCHAR")
    return f"WITH facts AS ({body}), safe AS (SELECT * FROM facts WHERE ({REASON}) IS NULL) "


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL for the same rows."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
