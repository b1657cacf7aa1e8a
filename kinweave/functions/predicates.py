"""Predicates that most reads over the graph share, each a Column over a frame's own columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quality flags and the confidence they stand for.
PHONE_CONFIDENCE = {"valid": 1.0, "partial_parse": 0.8, "stale": 0.6, "source_untrusted": 0.4, "shared_suspected": 0.3, "placeholder_value": 0.1, "invalid_format": 0.0}
USABLE = ("valid", "partial_parse")


def is_live(status: str = "lifecycle_status", latest: str = "is_latest") -> Column:
    """Active by state, or by the older flag where a record has no state."""
    return F.coalesce(F.col(status) == "active", F.col(latest), F.lit(False))


def is_activity(family: str = "history_family") -> Column:
    """Stage history is hidden from readers; records without a family are not history."""
    return F.col(family).isNull() | (F.col(family) == "activity")


def edge_active(flag: str = "is_active") -> Column:
    """A null flag means active."""
    return F.coalesce(F.col(flag), F.lit(True))


def usable_evidence(flag: str = "is_active", quality: str = "quality_flag") -> Column:
    """Matching is stricter than reading: a null flag is not active."""
    return F.coalesce(F.col(flag), F.lit(False)) & F.coalesce(F.col(quality).isin(*USABLE), F.lit(False))


def contains_ci(column: str, text: str) -> Column:
    return F.lower(F.col(column)).contains(text.lower())


def is_present(column: str, wanted: bool) -> Column:
    return F.col(column).isNotNull() == F.lit(wanted)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def phone_confidence(quality: str = "quality_flag") -> Column:
    pairs = [F.lit(x) for kv in PHONE_CONFIDENCE.items() for x in kv]
    return F.create_map(*pairs)[F.col(quality)]


def days_since(at: str, as_of: Column) -> Column:
    """Whole days from a timestamp to as_of, not below 0; null stays null."""
    return F.when(F.col(at).isNotNull(), F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400.0))).cast("long")


def order_nulls_last(column: str, descending: bool) -> Column:
    """The graph sorts null as the largest value: last ascending, first descending."""
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()
