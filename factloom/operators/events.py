"""Causal features of an event stream: each row sees only the rows strictly before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def alerts(events: DataFrame) -> DataFrame:
    """(event_id, us, ts, actor, host, technique, level) of the events table; us counts microseconds."""
    return events.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "ts",
        F.col("user_id").alias("actor"),
        (F.get_json_object("props", "$.k").cast("long") % 5).alias("host"),
        F.col("event_type").alias("technique"),
        F.col("value").alias("level"),
    )


def strictly_before(keys: list[str], span: int) -> Column:
    """Rows of the same keys before this one, by time and event id, not more than ``span`` microseconds back."""
    near = Window.partitionBy(*keys).orderBy("us").rangeBetween(-span, 0)
    peers = Window.partitionBy(*keys, "us")
    later_peers = F.count("*").over(peers) - F.row_number().over(peers.orderBy("event_id")) + 1
    return F.count("*").over(near) - later_peers


def first_of(*keys: str) -> Column:
    """1 for the first row of the keys, by time and event id, else 0."""
    return (F.row_number().over(Window.partitionBy(*keys).orderBy("us", "event_id")) == 1).cast("int")


def firsts(rows: DataFrame, *keys: str) -> DataFrame:
    """(event_id): events that are the first of their keys; minima by key, so no task holds a key's rows."""
    return rows.groupBy(*keys).agg(F.min(F.struct("us", "event_id")).alias("m")).select("m.event_id").distinct()


def with_firsts(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """Adds ``name``: 1 for the first row of the keys, by time and event id, else 0; ids are distinct."""
    out = rows.join(firsts(rows, *keys).withColumn(name, F.lit(1)), "event_id", "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def frequencies(rows: DataFrame) -> DataFrame:
    """Trailing counts over a day and a week."""
    return rows.withColumns({"freq_24h": strictly_before(["actor", "host", "technique"], 24 * HOUR), "freq_7d": strictly_before(["actor", "technique"], 168 * HOUR)})


def novelty(rows: DataFrame) -> DataFrame:
    rows = with_firsts(rows, "novel_actor", "actor")
    return with_firsts(with_firsts(rows, "novel_host_for_actor", "actor", "host"), "novel_actor_host_technique", "actor", "host", "technique")


def hour_band() -> Column:
    """Four bands of the day, times two for weekends: 0 to 7."""
    return (F.floor(F.hour("ts") / 6) + F.when(F.dayofweek("ts").isin(1, 7), 4).otherwise(0)).cast("long")


def time_typicality(rows: DataFrame) -> DataFrame:
    """Smoothed share of the actor's earlier events in this event's band."""
    rows = rows.withColumn("band", hour_band())
    before = lambda *keys: F.count("*").over(Window.partitionBy(*keys).orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    same, all_ = before("actor", "band"), before("actor")
    return rows.withColumns({"typicality": F.round((same + 1) / (all_ + 8), 6), "never_active": (same == 0).cast("int")})


def diversity(rows: DataFrame, span: int = HOUR // 4) -> DataFrame:
    """Distinct techniques of the actor in the trailing span, this one included, ties by event id.

    A technique counts from its first event until the span after its last one is over, so a running sum of
    starts and ends is enough; no row holds the events of its span.
    """
    same = Window.partitionBy("actor", "technique").orderBy("us", "event_id")
    before, after = F.lag("us").over(same), F.lead("us").over(same)
    known = F.col("technique").isNotNull()
    rows = rows.withColumns({"_starts": (known & (before.isNull() | (F.col("us") - before > span))).cast("int"), "_ends": known & (after.isNull() | (after - F.col("us") > span))})
    steps = rows.drop("_ends").withColumns({"_at": F.col("us"), "_kind": F.lit(0)})
    ends = rows.where("_ends").select("actor", (F.col("us") + span).alias("_at"), F.lit(1).alias("_kind"), F.lit(-1).alias("_starts"))
    so_far = Window.partitionBy("actor").orderBy("_at", "_kind", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.unionByName(ends, allowMissingColumns=True).withColumn("diversity", F.sum("_starts").over(so_far))
    return out.where("_kind = 0").drop("_starts", "_at", "_kind")


def escalation(rows: DataFrame, first: str, then: tuple[str, ...], span: int = HOUR // 4) -> DataFrame:
    """1 where one of ``then`` follows ``first`` of the same actor within the span, strictly before it."""
    last = F.max(F.when(F.col("technique") == first, F.col("us"))).over(Window.partitionBy("actor").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    hit = F.col("technique").isin(*then) & last.isNotNull() & (F.col("us") - last <= span)
    return rows.withColumn("escalation", F.coalesce(hit, F.lit(False)).cast("int"))


def chronological_split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds ``part``: train for the first ``share`` of the distinct days, else test."""
    days = rows.select(F.to_date("ts").alias("day")).distinct()
    bound = days.agg(F.sort_array(F.collect_set("day")).alias("d")).select(F.expr(f"element_at(d, CAST(floor(size(d) * {share}) AS int) + 1)").alias("bound"))
    return rows.join(F.broadcast(bound), how="cross").withColumn("part", F.when(F.to_date("ts") < F.col("bound"), "train").otherwise("test")).drop("bound")


def near_incidents(rows: DataFrame, incidents: DataFrame, span: int, keep: int = 10) -> DataFrame:
    """(incident_id, event_id, gap_us): up to ``keep`` nearest rows of each incident's actor within the span.

    Both sides get the bucket of their time, incidents the buckets beside it, too, so the interval join is an equi-join on actor and bucket.
    """
    bucket = F.floor(F.col("us") / span)
    left = rows.select("event_id", "actor", F.col("us").alias("_us"), bucket.alias("_b"))
    right = incidents.select("incident_id", "actor", "us", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b"))
    gap = F.abs(F.col("_us") - F.col("us"))
    near = left.join(right, ["actor", "_b"]).where(gap <= span).select("incident_id", "event_id", gap.alias("gap_us"))
    order = Window.partitionBy("incident_id").orderBy("gap_us", "event_id")
    return near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def transitions(rows: DataFrame, least_seconds: int) -> DataFrame:
    """(event_id, place, before, verdict) of each move of an actor between hosts: two places at once, or too fast, are violations."""
    own = Window.partitionBy("actor").orderBy("us", "event_id")
    rows = rows.withColumns({"before": F.lag("host").over(own), "_then": F.lag("us").over(own)})
    verdict = (
        F.when(F.col("before").isNull(), "introduced")
        .when(F.col("before") == F.col("host"), "stays")
        .when(F.col("us") == F.col("_then"), "bilocation")
        .when(F.col("us") - F.col("_then") < least_seconds * 1_000_000, "teleport")
        .otherwise("moves")
    )
    return rows.select("event_id", F.col("host").alias("place"), "before", verdict.alias("verdict"))


def multi_technique(rows: DataFrame) -> DataFrame:
    """(event_id, n_techniques, freq_7d, novel): least trailing count and any novelty over a row's techniques.

    ``rows`` has (event_id, us, actor, techniques); equal techniques of a row count once, rows without any have no row.
    """
    each = rows.select("event_id", "us", "actor", F.explode(F.array_distinct("techniques")).alias("technique"))
    keys = ["actor", "technique"]
    each = each.withColumns({"_f": strictly_before(keys, 168 * HOUR), "_n": first_of(*keys)})
    return each.groupBy("event_id").agg(F.count("*").alias("n_techniques"), F.min("_f").alias("freq_7d"), F.max("_n").alias("novel"))
