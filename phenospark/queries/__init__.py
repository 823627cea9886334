"""All registered queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = ["criteria_queries", "steplist_queries", "source_queries", "curation_queries", "catalog_queries", "learning_queries",
            "exchange_queries", "keyword_queries", "extra_queries", "stem_queries"]


def _collect(attr: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"phenospark.queries.{m}")
        out.update(getattr(mod, attr))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
