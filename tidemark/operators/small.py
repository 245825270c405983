"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a table may have by Spark's estimate to be broadcast.
MOST = 16 << 20


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` with a broadcast hint if Spark's estimate of it is at most ``most`` bytes: files, local rows and what is selected of them, known without a job. What cannot be estimated stays
    without a hint, and adaptive execution decides when it knows the size."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most else df
