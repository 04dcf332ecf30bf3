"""Records that arrive as JSON or XML text, parsed to columns: works, stream hits, feed entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORK = "id string, title string, url string, abstract_index map<string, array<int>>"
HIT = "timestamp string, agent struct<name: string>, data struct<user: string, srcuser: string>, rule struct<level: int, technique: array<string>>"
ENTRY = "id string, title string, author array<struct<name: string>>"


def from_index(index: Column) -> Column:
    """Text of a map from words to places: the words in order of their places."""
    entries = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(entries), lambda s: s["word"]), " ")


def works(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns with id, title, url and abstract of each work; works without one of these, and bad JSON, have no row."""
    rows = payloads.withColumn("_w", F.from_json(payload, WORK))
    kept = [c for c in payloads.columns if c not in (payload, "id", "title", "url", "abstract")]
    rows = rows.select(*kept, "_w.id", "_w.title", "_w.url", from_index(F.col("_w.abstract_index")).alias("abstract"))
    return rows.where("id IS NOT NULL AND title != '' AND url != '' AND abstract != ''")


def hits(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns with us, host, level, techniques, actor, tier, missing_subject and host_fallback of each hit.

    The actor is the user, else the source user, else the host (tier 1 to 3; null and 4
    where none is known). Bad JSON gives nulls.
    """
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    user, source, host = named(F.col("_h.data.user")), named(F.col("_h.data.srcuser")), named(F.col("_h.agent.name"))
    tier = F.when(user.isNotNull(), 1).when(source.isNotNull(), 2).when(host.isNotNull(), 3).otherwise(4)
    rows = payloads.withColumn("_h", F.from_json(payload, HIT))
    new = {
        "us": F.unix_micros(F.try_to_timestamp("_h.timestamp")), "host": host, "level": F.col("_h.rule.level"), "techniques": F.col("_h.rule.technique"),
        "actor": F.coalesce(user, source, host), "tier": tier, "missing_subject": (tier >= 2).cast("int"), "host_fallback": (tier == 3).cast("int"),
    }
    return rows.select(*(c for c in payloads.columns if c != payload and c not in new), *(v.alias(c) for c, v in new.items()))


def entries(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """The other columns with id, title and authors of each feed entry; bad XML, and entries without a title, have no row."""
    rows = payloads.withColumn("_e", F.from_xml(payload, ENTRY))
    kept = [c for c in payloads.columns if c not in (payload, "id", "title", "authors")]
    authors = F.coalesce(F.filter(F.transform("_e.author", lambda a: a["name"]), lambda n: n.isNotNull()), F.array().cast("array<string>"))
    return rows.select(*kept, "_e.id", "_e.title", authors.alias("authors")).where("title != ''")
