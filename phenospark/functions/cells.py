"""Reading the packed cells of a potential-cases table.

A cell may pack several dated events as ``(code,date),(code,date)``; codes are
taken with the patterns below from every column the criterion looks at.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two cell patterns of the data model.
CODE_PATTERN = r"\(([^,]*),"
DATED_CODE_PATTERN = r"\(([^,]*),([^,]*)\)"



def empty_strings() -> Column:
    return F.array().cast("array<string>")


def q(name: str) -> Column:
    """Column by name; names carry '-' so they are always back-quoted."""
    return F.col("`" + name.replace("`", "``") + "`")


def cell_codes(cell: Column) -> Column:
    """Every ``(code,`` of one cell, in order; NULL cell -> empty array."""
    return F.coalesce(F.regexp_extract_all(cell.cast("string"), F.lit(CODE_PATTERN), 1), empty_strings())


def row_codes(columns: Iterable[str]) -> Column:
    """Codes of all listed columns, in column order then cell order."""
    parts = [cell_codes(q(c)) for c in columns]
    return F.concat(*parts) if parts else empty_strings()


def cell_dated_codes(cell: Column) -> Column:
    """Every ``(code,date)`` of one cell as ``struct<code, ts>``; the date is
    parsed leniently (ISO date or date-time), unparseable -> NULL ts."""
    text = cell.cast("string")
    codes = F.regexp_extract_all(text, F.lit(DATED_CODE_PATTERN), 1)
    dates = F.regexp_extract_all(text, F.lit(DATED_CODE_PATTERN), 2)
    zipped = F.zip_with(codes, dates, lambda c, d: F.struct(c.alias("code"), d.try_cast("timestamp").alias("ts")))
    return F.coalesce(zipped, F.array().cast("array<struct<code:string,ts:timestamp>>"))


def row_dated_codes(columns: Iterable[str]) -> Column:
    parts = [cell_dated_codes(q(c)) for c in columns]
    return F.concat(*parts) if parts else F.array().cast("array<struct<code:string,ts:timestamp>>")


def plain_items(cell: Column) -> Column:
    """Older cell form ``X01,X02``: split on commas."""
    return F.coalesce(F.split(cell.cast("string"), ","), empty_strings())


def in_codes(x: Column, codes: list[str]) -> Column:
    """Membership in a literal code list (Catalyst turns long lists into InSet)."""
    return x.isin(list(codes))
