"""Safety of facts as columns: why a hop is refused, and whether a fact may be answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Predicates that need a dated snapshot.
CURRENT_SENSITIVE = ("leader_of", "valued_at")


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def hop_reason() -> Column:
    """First reason for which a fact is no safe hop; null for a safe one."""
    predicate, kind, dated = _text("predicate"), _text("temporal_class"), _text("as_of") != ""
    reason = lambda name: F.concat(F.lit(f"{name}:"), predicate)
    return (
        F.when(kind.isin("snapshot", "aggregate") & ~dated, reason("snapshot_missing_as_of"))
        .when(_text("stability") == "volatile", reason("volatile_relation"))
        .when(_text("risk") == "high", reason("high_risk_relation"))
        .when(predicate.isin(*CURRENT_SENSITIVE) & ~((kind == "snapshot") & dated), reason("current_sensitive"))
    )


def hop_safe() -> Column:
    """Whether a fact may be used as a hop."""
    return hop_reason().isNull()


def answerable() -> Column:
    """Whether a fact may be given as an answer."""
    return _text("stability").isin("stable", "semi_stable") & ~_text("predicate").isin(*CURRENT_SENSITIVE) & (F.lower(_text("risk")) != "high")
