"""All causal features of security alerts: each alert sees only the alerts before it, by time and id.

Alerts have event_id, us (microseconds), node, category, subject_user, subject_domain, event_user, host, techniques and
tactics (arrays, the main one first), parent and image. No window spans a key's whole history: trailing spans look
at the bucket of their length and the one before, counts of all that went before add up days first, and first
rows are minima by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.lineage import cut
from factloom.functions.words import domain_user
from factloom.operators.events import HOUR, firsts, hour_band

#: Fixed values of the features: windows, tactics, the image of alerts without one, buckets of time.
DAY, WEEK, CHAIN = 24 * HOUR, 168 * HOUR, HOUR // 4
DISCOVERY, ESCALATION = "Discovery", ("Credential Access", "Lateral Movement")
NO_IMAGE = "(unknown-image)"
BANDS = 8
#: How many of an alert's techniques are read and kept: only the first; the first, but all are kept; all.
MODES = ("first_only", "primary_plus_count", "aggregate")
FEATURES = (
    "freq_actor_host_technique_24h", "freq_actor_technique_7d", "novel_actor_host_technique", "novel_host_for_actor", "novel_actor", "actor_time_typicality", "actor_never_active_this_bucket",
    "chain_tactic_diversity_15m", "chain_discovery_to_escalation_15m", "process_chain_novel_for_host", "actor_identity_missing_subject", "actor_identity_host_fallback",
)
_ORDER = ["us", "event_id"]


def feature_names(mode: str) -> tuple[str, ...]:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; expected one of {MODES}")
    return FEATURES if mode == "first_only" else (*FEATURES, "technique_multiplicity")


def guarded(alerts: DataFrame, excluded: list[str], category: str = "process_creation") -> DataFrame:
    """Alerts of one category; an alert of an excluded node is an error, as it must be filtered out where alerts are read."""
    bad = F.raise_error(F.concat(F.lit("alert of an excluded node: "), F.col("node")))
    return alerts.where(F.when(F.col("node").isin(excluded), bad.cast("boolean")).otherwise(F.col("category") == category))


def identified(alerts: DataFrame) -> DataFrame:
    """Adds actor (user and domain in one), both identity flags, the child image and the time band."""
    usable = lambda c: F.coalesce(c.rlike(r"\S"), F.lit(False))
    other = domain_user(F.col("event_user"))
    subject, second = usable(F.col("subject_user")), usable(F.col("event_user")) & usable(other["user"])
    user = F.when(subject, F.col("subject_user")).when(second, other["user"]).otherwise(F.concat(F.lit("(host:"), "host", F.lit(")")))
    domain = F.when(subject, F.when(usable(F.col("subject_domain")), F.col("subject_domain"))).when(second, other["domain"])
    return alerts.withColumns({
        "actor": F.concat(user, F.lit("\x1f"), F.coalesce(domain, F.lit(""))),
        "actor_identity_missing_subject": (~subject).cast("int"),
        "actor_identity_host_fallback": (~subject & ~second).cast("int"),
        "image": F.coalesce("image", F.lit(NO_IMAGE)),
        "ts": F.timestamp_micros("us"),
    }).withColumn("band", hour_band())


def _values(name: str) -> Column:
    """The distinct values of an array column, in order; one null where there are none."""
    own = F.array_distinct(F.filter(name, lambda v: v.isNotNull()))
    return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, own).otherwise(F.array(F.lit(None).cast("string")))


def listed(alerts: DataFrame) -> DataFrame:
    return alerts.withColumns({"techniques": _values("techniques"), "tactics": _values("tactics")})


def _near(rows: DataFrame, span: int) -> DataFrame:
    """Each row in the bucket of its time and, as one that is only looked at, in the next one: ``_b`` and ``_own``."""
    bucket = F.floor(F.col("us") / span)
    return rows.withColumn("_b", F.explode(F.array(bucket, bucket + 1))).withColumn("_own", F.col("_b") == bucket)


def trailing(rows: DataFrame, keys: list[str], span: int, name: str, *carried: str) -> DataFrame:
    """(event_id, *keys, *carried, name): rows of the same keys before this one, not more than ``span`` back; a key has one row for each event.

    That is the number of all rows before it less those before its span, both from one running sum, so a hot key takes
    time in proportion to its rows.
    """
    rows = _near(rows.select("event_id", "us", *keys, *carried), span)
    own = F.struct(F.col("us").alias("at"), F.lit(1).alias("kind"))
    limit = F.struct((F.col("us") - span).alias("at"), F.lit(0).alias("kind"))
    steps = rows.withColumn("_p", F.explode(F.when(F.col("_own"), F.array(own, limit)).otherwise(F.array(own)))).select("*", "_p.at", "_p.kind").drop("_p")
    so_far = F.sum("kind").over(Window.partitionBy(*keys, "_b").orderBy("at", "kind", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    found = steps.withColumn(name, F.when(F.col("kind") == 1, so_far - 1).otherwise(-so_far)).where("_own")
    return found.groupBy("event_id", *keys, *carried).agg(F.sum(name).alias(name))


def counted_before(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(event_id, name): all rows of the keys before this one: of the days before, summed by day, and of its day."""
    day = F.floor(F.col("us") / DAY)
    rows = rows.select("event_id", "us", *keys, day.alias("_d"))
    days = rows.groupBy(*keys, "_d").agg(F.count("*").alias("_n"))
    past = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys, "_d").orderBy(*_ORDER)) - 1
    return rows.withColumn("_p", place).join(days.withColumn("_past", past), [*keys, "_d"]).select("event_id", (F.col("_past") + F.col("_p")).alias(name))


def chains(alerts: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(event_id, diversity) and (event_id, escalation) within the trailing quarter of an hour of an actor on a host.

    A tactic lives from one of its alerts until the span after it is over, so running sums of starts and ends tell how
    many live before an alert; those of its own that don't yet live come on top.
    """
    kept = F.slice("tactics", 1, 1) if mode == "first_only" else F.col("tactics")
    read = F.col("tactics") if mode == "aggregate" else F.slice("tactics", 1, 1)
    own = alerts.select("event_id", "us", "actor", "host", F.posexplode(kept).alias("_i", "tactic"), F.size(read).alias("_read"))
    rows = _near(own, CHAIN)
    keys = ["actor", "host", "_b"]
    same = Window.partitionBy(*keys, "tactic").orderBy(*_ORDER)
    before, after = F.lag("us").over(same), F.lead("us").over(same)
    starts = before.isNull() | (F.col("us") - before > CHAIN)
    rows = rows.withColumns({"_starts": starts.cast("int"), "_ends": after.isNull() | (after - F.col("us") > CHAIN)})
    steps = rows.drop("_ends").withColumns({"_at": F.col("us"), "_kind": F.lit(0)})
    ends = rows.where("_ends").select(*keys, (F.col("us") + CHAIN).alias("_at"), F.lit(1).alias("_kind"), F.lit(-1).alias("_starts"))
    # peers of one alert count together, and its own starts are taken off again
    so_far = F.sum("_starts").over(Window.partitionBy(*keys).orderBy("_at", "_kind", "event_id"))
    mine = Window.partitionBy(*keys, "event_id")
    steps = steps.unionByName(ends, allowMissingColumns=True).withColumn("_live", so_far).where("_kind = 0").withColumn("_live", F.col("_live") - F.sum("_starts").over(mine))
    new = F.sum(F.when(F.col("_i") < F.col("_read"), F.col("_starts")).otherwise(0))
    diversity = steps.where("_own").groupBy("event_id").agg((F.first("_live") + new).alias("chain_tactic_diversity_15m"))
    found = _near(alerts.select("event_id", "us", "actor", "host", F.array_contains(kept, DISCOVERY).alias("_found"), F.arrays_overlap(read, F.array(*map(F.lit, ESCALATION))).alias("_up")), CHAIN)
    last = F.max(F.when(F.col("_found"), F.col("us"))).over(Window.partitionBy(*keys).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1))
    hit = F.coalesce(F.col("_up") & (F.col("us") - last <= CHAIN), F.lit(False))
    escalation = found.withColumn("chain_discovery_to_escalation_15m", hit.cast("int")).where("_own").select("event_id", "chain_discovery_to_escalation_15m")
    return diversity, escalation


def features(alerts: DataFrame, mode: str = "aggregate") -> DataFrame:
    """(event_id, features) of each alert; ids are distinct.

    Values of several techniques meet at their least explained end: the least count, any novelty. Alerts are read once
    into the shared folder; all features of an alert meet in one grouping.
    """
    names = feature_names(mode)
    rows = cut(listed(identified(alerts)).select("event_id", "us", "actor", "host", "band", "parent", "image", "techniques", "tactics", *FEATURES[-2:]))
    kept = F.slice("techniques", 1, 1) if mode == "first_only" else F.col("techniques")
    each = rows.select("event_id", "us", "actor", "host", F.posexplode(kept).alias("_i", "technique"))
    each = each.withColumn("_read", F.lit(True) if mode == "aggregate" else F.col("_i") == 0).drop("_i")
    here, anywhere = ["actor", "host", "technique"], ["actor", "technique"]
    new = each.groupBy(*here).agg(F.min(F.struct(*_ORDER, "_read")).alias("m")).where("m._read").select("m.event_id", F.lit(1).alias(names[2]))
    parts = [
        rows.select("event_id", *FEATURES[-2:], F.size("techniques").cast("long").alias("technique_multiplicity")),
        *(trailing(each, keys, span, name, "_read").where("_read").select("event_id", name) for keys, span, name in ((here, DAY, names[0]), (anywhere, WEEK, names[1]))),
        new,
        *(firsts(rows, *keys).withColumn(name, F.lit(1)) for name, keys in (("novel_host_for_actor", ("actor", "host")), ("novel_actor", ("actor",)), ("process_chain_novel_for_host", ("host", "parent", "image")))),
        counted_before(rows, ["actor", "band"], "_same"),
        counted_before(rows, ["actor"], "_all"),
        *chains(rows, mode),
    ]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    out = whole.groupBy("event_id").agg(*((F.min if c in names[:2] else F.max)(c).alias(c) for c in whole.columns if c != "event_id"))
    out = out.dropna(subset=["event_id", *names[:2], "_same", "_all", *names[7:9], "technique_multiplicity"])
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in (names[2], names[3], names[4], names[9])})
    out = out.withColumns({"actor_time_typicality": F.round((F.col("_same") + 1) / (F.col("_all") + BANDS), 6), "actor_never_active_this_bucket": (F.col("_same") == 0).cast("int")})
    return out.select("event_id", *names)
