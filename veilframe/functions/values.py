"""Defaults and casts shared by the table transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_VISIT_REASON = "routine evaluation"


def to_label(value: Column, null_token: str) -> Column:
    """Text of ``value`` with ``null_token`` in place of null."""
    return F.coalesce(value.cast("string"), F.lit(null_token))


def to_cost(value: Column, bad_cost: str = "raise") -> Column:
    """Cost as a double; null stays null, and so does NaN, which would spoil sums.
    ``bad_cost="null"`` turns unreadable text into null instead of failing."""
    if bad_cost not in ("raise", "null"):
        raise ValueError("bad_cost must be 'raise' or 'null'")
    cost = value.try_cast("double")
    if bad_cost == "raise":
        # The message names no value, and raising does not depend on session settings.
        unreadable = value.isNotNull() & cost.isNull()
        cost = F.when(unreadable, F.raise_error(F.lit("a cost is not a number")).cast("double")).otherwise(cost)
    return F.nanvl(cost, F.lit(None).cast("double"))


def note_or_default(note: Column, visit_reason: Column) -> Column:
    """The note, or a one-line note naming the visit reason where it is null or empty."""
    default = F.concat(F.lit("Patient presented for "), visit_reason, F.lit("."))
    return F.coalesce(F.nullif(note.cast("string"), F.lit("")), default)


def preview(value: Column, chars: int) -> Column:
    """Leading characters of a long result, for display only."""
    return F.substring(value.cast("string"), 1, chars)
