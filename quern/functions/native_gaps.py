"""The few text functions that have no built-in expression, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


@pandas_udf(StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """Unicode NFKC."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings (not an edit distance)."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
