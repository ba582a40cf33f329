"""Name similarity as an Arrow-batched function."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts; null when a side is missing."""
    return pd.Series([
        None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)
    ], dtype="float64")
