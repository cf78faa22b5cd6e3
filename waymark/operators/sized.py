"""Broadcast behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
ROWS = 500_000


def is_small(df: DataFrame, rows: int = ROWS) -> bool:
    """Whether the optimiser's own bound on the size, or a count that stops early, allows a broadcast."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known <= 8 << 20 or df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small."""
    return F.broadcast(df) if is_small(df, rows) else df
