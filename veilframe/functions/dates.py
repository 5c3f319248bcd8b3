"""Date parsing, shifting and age buckets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an ISO date with an optional time of day and zone.
ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?\s*$"

# Other dates read after ISO, month first and day first only where the
# month cannot be one, as date parsers commonly do.
SLASHED_DATES = (
    "M/d/yyyy[ H:mm[:ss]]", "d/M/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a", "M/d/yy",
    "yyyyMMdd", "yyyy.M.d", "yyyy-MM", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)

# Age groups.
TOP_AGE = 90
ADULT_AGE = 18
TOP_BUCKET = "90+"
MINOR_BUCKET = "0-17"
UNKNOWN_BUCKET = "UNKNOWN"


def parse_date(value: Column, formats: Sequence[str] = SLASHED_DATES) -> Column:
    """Calendar date written in ``value``; null where it cannot be read. A zone offset does not move the date. ``formats`` are further
    Spark datetime patterns, tried in order after ISO."""
    text = value.cast("string")
    iso = F.when(text.rlike(ISO_DATE), text.try_cast("date"))
    others = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return F.coalesce(iso, *others) if others else iso


def unreadable_date(value: Column, formats: Sequence[str] = SLASHED_DATES) -> Column:
    """True where a date is given but cannot be read."""
    given = F.trim(F.coalesce(value.cast("string"), F.lit(""))) != ""
    return given & parse_date(value, formats).isNull()


def shift_date(value: Column, days: Column, formats: Sequence[str] = SLASHED_DATES) -> Column:
    """``value`` moved by ``days`` as ``yyyy-MM-dd`` text, null where unreadable."""
    return F.date_add(parse_date(value, formats), days).cast("string")


def age_bucket(
    birth_date: Column,
    reference_date: dt.date | str | Column | None = None,
    formats: Sequence[str] = SLASHED_DATES,
) -> Column:
    """Age group at ``reference_date`` (default today): everyone from 90 up shares one
    bucket, minors another, the rest go by decade; null where the date is unreadable
    gives ``UNKNOWN``."""
    return age_group(age_in_years(parse_date(birth_date, formats), reference_date))


def age_in_years(born: Column, reference_date: dt.date | str | Column | None = None) -> Column:
    """Birthdays passed since the date ``born``."""
    if reference_date is None:
        reference = F.current_date()
    elif isinstance(reference_date, Column):
        reference = reference_date
    else:
        reference = F.lit(str(reference_date)).cast("date")
    # As numbers yyyymmdd two dates are a whole year apart exactly on the birthday.
    return F.floor((_as_number(reference) - _as_number(born)) / 10_000)


def _as_number(date: Column) -> Column:
    return F.year(date) * 10_000 + F.month(date) * 100 + F.dayofmonth(date)


def age_group(age: Column) -> Column:
    decade = age - age % 10
    return (
        F.when(age >= TOP_AGE, TOP_BUCKET)
        .when(age < ADULT_AGE, MINOR_BUCKET)
        .when(age.isNotNull(), F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string")))
        .otherwise(UNKNOWN_BUCKET)
    )
