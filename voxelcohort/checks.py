"""Schema checks that cost no job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}; found {sorted(df.columns)}")
    return df
