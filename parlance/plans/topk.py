"""Ranking of already aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    rows: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key.  Spark limits each task to ``n`` rows per key before it shuffles,
    so the final group holds at most n x tasks rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
