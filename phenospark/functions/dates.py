"""Date rules of the criteria, as built-in expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def parse_date(c: Column) -> Column:
    """Lenient ISO parse; bad or zero dates ('0000-00-00') give NULL."""
    return c.cast("string").try_cast("timestamp")


def as_of_lit(as_of) -> Column:
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of[:10])
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.date()
    return F.lit(as_of)


def age_years(dob_ts: Column, as_of) -> Column:
    """Whole years at ``as_of``, one less while the birthday is still ahead."""
    ref = as_of_lit(as_of)
    birthday_ahead = (F.month(ref) < F.month(dob_ts)) | (
        (F.month(ref) == F.month(dob_ts)) & (F.dayofmonth(ref) < F.dayofmonth(dob_ts)))
    return F.year(ref) - F.year(dob_ts) - birthday_ahead.cast("int")


def calendar_year_gap(ts: Column, as_of) -> Column:
    """Difference of calendar years, not elapsed time."""
    return F.year(as_of_lit(as_of)) - F.year(ts)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, floored (time of day counts).
    Zone-less timestamps are read as session-zone (UTC) wall time."""
    diff = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(diff / F.lit(MICROS_PER_DAY)).cast("long")
