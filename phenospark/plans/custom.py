"""user-supplied step implementations.

A custom step is either a DataFrame function (``df -> df``, composed with
``DataFrame.transform`` so it joins the same plan) or, when the logic is
per-row Python, a pandas function applied batch-wise with ``mapInPandas``
(Arrow batches, never row at a time).  Either way the step must keep every
input row and may only append columns, like any other criterion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def custom_step(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    out = df.transform(fn)
    missing = [c for c in df.columns if c not in out.columns]
    if missing:
        raise ValueError(f"a step may only append columns; lost {missing}")
    return out


def custom_row_step(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], new_columns: str) -> DataFrame:
    """``fn`` maps a pandas batch to the same rows plus ``new_columns``
    (a DDL string such as ``"risk-identified string"``)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + new_columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = fn(pdf.copy())
            if len(out) != len(pdf):
                raise ValueError("a custom step must keep every row")
            yield out

    return df.mapInPandas(run, schema)
