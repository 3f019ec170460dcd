"""The two functions that need Python, as vectorised functions over Arrow batches."""

from __future__ import annotations

import difflib
from datetime import datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def street_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; it depends on the order of its arguments, so callers put the lower id first."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@lru_cache(maxsize=1 << 16)
def lenient(x: str, as_of: str) -> datetime | None:
    """One text of fuzzy_date(); a worker parses a text once as long as it is among the last ones."""
    from dateutil import parser

    try:
        return parser.parse(x, fuzzy=True, default=pd.Timestamp(as_of).to_pydatetime()).replace(tzinfo=None) if x else None
    except (ValueError, OverflowError):
        return None


def fuzzy_date(c: Column, as_of: str) -> Column:
    """A lenient date parse with missing parts from as_of, for texts that the patterns of dates.py miss."""

    @F.pandas_udf(T.TimestampNTZType())
    def parse(s: pd.Series) -> pd.Series:
        return pd.Series([lenient(x, as_of) for x in s], dtype="datetime64[ns]")

    return parse(c)
