"""named data connectors.  A connector is ``fn(spark) -> DataFrame`` that
must yield the potential-cases contract (``patient-id, dob, codes,
last-encounter``); any existing definition runs on any registered source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

COHORT_COLUMNS = ("patient-id", "dob", "codes", "last-encounter")
_SOURCES: dict[str, Callable[[SparkSession], DataFrame]] = {}


def register_source(name: str, fn: Callable[[SparkSession], DataFrame]) -> None:
    _SOURCES[name] = fn


def read_source(name: str, spark: SparkSession) -> DataFrame:
    if name not in _SOURCES:
        raise KeyError(f"no source {name!r}; registered: {sorted(_SOURCES)}")
    df = _SOURCES[name](spark)
    missing = [c for c in COHORT_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"source {name!r} lacks columns {missing}")
    return df


def sources() -> list[str]:
    return sorted(_SOURCES)
