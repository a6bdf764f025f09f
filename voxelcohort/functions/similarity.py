"""Fuzzy text similarity for short names."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def seq_ratio(candidate: pd.Series, word: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of each candidate to the word it might stand for."""
    known: dict[tuple[str, str], float] = {}  # file names repeat from directory to directory
    out = []
    for pair in zip(candidate, word):
        if None in pair:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = SequenceMatcher(None, *pair).ratio()
        out.append(known[pair])
    return pd.Series(out, dtype="float64")
