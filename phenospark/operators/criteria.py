"""Criteria over the wide potential-cases table (one row per patient).

Each criterion appends exactly one flag column and never drops a row, so a
chain of criteria is a chain of projections that whole-stage codegen fuses
into one pass.  Flag values are strings, as in the table model:
``<category>-identified`` is CASE/UNK, ``<category>-exclusion`` is TRUE/FALSE.
Column order is meaningful (see :func:`resolve_cases`), so every operator
keeps the input columns in place and appends on the right.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenospark.functions.cells import plain_items, q, row_codes, row_dated_codes
from phenospark.functions.dates import age_years, calendar_year_gap, floor_days, parse_date

# Flag vocabulary of the table model.
CASE, UNK = "CASE", "UNK"
TRUE, FALSE = "TRUE", "FALSE"
IDENTIFIED, EXCLUSION = "identified", "exclusion"


def case_flag(cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(CASE)).otherwise(F.lit(UNK))


def exclusion_flag(cond: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(TRUE)).otherwise(F.lit(FALSE))


def _append(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Append (or replace in place) one column, keeping column order."""
    if name in df.columns:
        return df.select(*[value.alias(name) if c == name else q(c) for c in df.columns])
    return df.select(*[q(c) for c in df.columns], value.alias(name))


def _columns(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(df.columns) if cols is None else list(cols)


def _codes(codes: Iterable[str]) -> list[str]:
    out = [str(c) for c in codes]
    if not out:
        raise ValueError("a codelist needs at least one code")
    return out


# C1 -------------------------------------------------------------------------
def codelist(df: DataFrame, category: str, codes: Iterable[str], required: int = 1,
             cols: Sequence[str] | None = None) -> DataFrame:
    """CASE when at least ``required`` extracted codes (repeats count) are in
    the list; codes are read from every column (or ``cols``) in order."""
    if int(required) < 1:
        raise ValueError("required must be >= 1")
    codes = _codes(codes)
    hits = F.size(F.filter(row_codes(_columns(df, cols)), lambda x: x.isin(codes)))
    return _append(df, f"{category}-{IDENTIFIED}", case_flag(hits >= F.lit(int(required))))


# C2 -------------------------------------------------------------------------
def codelist_plain(df: DataFrame, category: str, codes: Iterable[str],
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Older plain cells (``X01,X02``): CASE if any comma item is in the list."""
    codes = _codes(codes)
    conds = [F.exists(plain_items(q(c)), lambda x: x.isin(codes)) for c in _columns(df, cols)]
    cond = F.lit(False)
    for c in conds:
        cond = cond | F.coalesce(c, F.lit(False))
    return _append(df, f"{category}-{IDENTIFIED}", case_flag(cond))


# C3 -------------------------------------------------------------------------
def codelist_exclude(df: DataFrame, category: str, codes: Iterable[str],
                     cols: Sequence[str] | None = None) -> DataFrame:
    """TRUE when any extracted code is in the list."""
    codes = _codes(codes)
    hit = F.exists(row_codes(_columns(df, cols)), lambda x: x.isin(codes))
    return _append(df, f"{category}-{EXCLUSION}", exclusion_flag(hit))


# C4 -------------------------------------------------------------------------
def codelists_temporal(df: DataFrame, category: str, before: Iterable[str], after: Iterable[str],
                       min_days: int, max_days: int, order: str = "listed",
                       cols: Sequence[str] | None = None) -> DataFrame:
    """CASE iff ``min_days < days < max_days`` between a *before* hit and an
    *after* hit; ``days`` is the floor of the time difference.

    ``order='listed'``: the last-listed before hit against the first-listed
    after hit (the table model's behaviour).  ``order='date'``: the latest
    before date against the earliest after date.  Undated events never match.
    """
    before, after = _codes(before), _codes(after)
    items = row_dated_codes(_columns(df, cols))
    b = F.filter(items, lambda x: x["code"].isin(before) & x["ts"].isNotNull())
    a = F.filter(items, lambda x: x["code"].isin(after) & x["ts"].isNotNull())
    if order == "listed":
        b_ts, a_ts = F.element_at(b, -1)["ts"], F.element_at(a, 1)["ts"]
    elif order == "date":
        b_ts = F.array_max(F.transform(b, lambda x: x["ts"]))
        a_ts = F.array_min(F.transform(a, lambda x: x["ts"]))
    else:
        raise ValueError("order must be 'listed' or 'date'")
    # element_at on an empty array is an error under ANSI; guard by size.
    days = F.when((F.size(b) > 0) & (F.size(a) > 0), floor_days(a_ts, b_ts))
    cond = (F.lit(int(min_days)) < days) & (days < F.lit(int(max_days)))
    return _append(df, f"{category}-{IDENTIFIED}", case_flag(cond))


# C5 / C6 --------------------------------------------------------------------
def _regex(pattern: str) -> str:
    # Case-insensitive with Unicode case folding, like a str regex search.
    return "(?iu)" + pattern


def keyword_hit(df: DataFrame, patterns: Iterable[str], cols: Sequence[str] | None = None) -> Column:
    patterns = list(patterns)
    if not patterns:
        raise ValueError("a keyword list needs at least one pattern")
    cond = F.lit(False)
    for c in _columns(df, cols):
        for p in patterns:
            cond = cond | F.coalesce(q(c).cast("string").rlike(_regex(p)), F.lit(False))
    return cond


def keywords(df: DataFrame, category: str, patterns: Iterable[str],
             cols: Sequence[str] | None = None) -> DataFrame:
    """CASE when any pattern (case-insensitive regex search) hits any column."""
    return _append(df, f"{category}-{IDENTIFIED}", case_flag(keyword_hit(df, patterns, cols)))


def keyword_categories(df: DataFrame, positives: Mapping[str, Iterable[str]],
                       exclusions: Mapping[str, Iterable[str]] | None = None,
                       cols: Sequence[str] | None = None) -> DataFrame:
    """Several keyword categories in one projection; a category that also has
    exclusion patterns is CASE only where no exclusion pattern hits."""
    exclusions = dict(exclusions or {})
    out = df
    new_cols = []
    for cat, pats in positives.items():
        cond = keyword_hit(df, pats, cols)
        if cat in exclusions:
            cond = cond & ~keyword_hit(df, exclusions[cat], cols)
        new_cols.append(case_flag(cond).alias(f"{cat}-{IDENTIFIED}"))
    return out.select(*[q(c) for c in df.columns], *new_cols)


# C7 / C8 --------------------------------------------------------------------
def _age_in_range(df: DataFrame, lower: int, upper: int, as_of, dob_col: str) -> Column:
    age = age_years(parse_date(q(dob_col)), as_of)
    return (age >= F.lit(int(lower))) & (age < F.lit(int(upper)))


def age(df: DataFrame, lower: int, upper: int, as_of, dob_col: str = "dob", name: str = "age") -> DataFrame:
    """``<name>-exclusion`` is FALSE iff ``lower <= age < upper`` at ``as_of``;
    an unreadable date of birth excludes."""
    inside = F.coalesce(_age_in_range(df, lower, upper, as_of, dob_col), F.lit(False))
    return _append(df, f"{name}-{EXCLUSION}", F.when(inside, F.lit(FALSE)).otherwise(F.lit(TRUE)))


def age_identified(df: DataFrame, lower: int, upper: int, as_of, dob_col: str = "dob") -> DataFrame:
    """Same range, written as ``age-identified`` CASE/UNK."""
    return _append(df, f"age-{IDENTIFIED}", case_flag(_age_in_range(df, lower, upper, as_of, dob_col)))


# C9 -------------------------------------------------------------------------
def last_encounter(df: DataFrame, max_years: int, as_of, col: str = "last-encounter",
                   name: str = "last-encounter") -> DataFrame:
    """``<name>-exclusion`` FALSE iff the calendar-year gap to
    ``as_of`` is below ``max_years``; unreadable date excludes."""
    recent = F.coalesce(calendar_year_gap(parse_date(q(col)), as_of) < F.lit(int(max_years)), F.lit(False))
    return _append(df, f"{name}-{EXCLUSION}", F.when(recent, F.lit(FALSE)).otherwise(F.lit(TRUE)))


# C10 ------------------------------------------------------------------------
def boolean_rule(df: DataFrame, out: str, predicate: Column | str,
                 required_cols: Iterable[str] = ()) -> DataFrame:
    """Rule over numeric or flag columns: CASE where the predicate holds; UNK
    for every row when a required column is absent from the table."""
    if any(c not in df.columns for c in required_cols):
        return _append(df, out, F.lit(UNK))
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    return _append(df, out, case_flag(pred))


# C13 ------------------------------------------------------------------------
def _resolved(df: DataFrame) -> list[tuple[str, Column]]:
    """Every ``identified`` column turns UNK when an ``exclusion`` column to
    its left is TRUE; column order kept."""
    out, excl_left = [], []
    for c in df.columns:
        col = q(c)
        if IDENTIFIED in c and excl_left:
            any_excl = F.lit(False)
            for e in excl_left:
                any_excl = any_excl | F.coalesce(q(e) == F.lit(TRUE), F.lit(False))
            col = F.when(any_excl, F.lit(UNK)).otherwise(col)
        out.append((c, col))
        if EXCLUSION in c:
            excl_left.append(c)
    return out


def resolve_cases(df: DataFrame) -> DataFrame:
    """One projection over all flags."""
    return df.select(*[col.alias(c) for c, col in _resolved(df)])


# C14 ------------------------------------------------------------------------
def nested_cases(df: DataFrame, groups: Sequence[Sequence[str]], name: str) -> DataFrame:
    """Resolve, then ``<name>-identified`` is CASE iff every group holds a CASE
    among its present columns; group and exclusion columns are dropped.  The
    remaining columns keep their input order, the new flag comes last."""
    by_name = dict(_resolved(df))
    cond = F.lit(True)
    for group in groups:
        present = [c for c in group if c in by_name]
        g = F.lit(False)
        for c in present:
            g = g | F.coalesce(by_name[c] == F.lit(CASE), F.lit(False))
        cond = cond & g
    dropped = {c for g in groups for c in g} | {c for c in df.columns if EXCLUSION in c}
    keep = [by_name[c].alias(c) for c in df.columns if c not in dropped]
    return df.select(*keep, case_flag(cond).alias(f"{name}-{IDENTIFIED}"))
